"""Text helpers: white space, line splitting, comment and string masks, binary sniffing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space set of the source language family's own engine (wider than
# Java's ``\s`` and than Spark's ``trim``), and its line terminators.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_INNER = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Most characters fail the first of the two sets, without a look at the second. In that the common ones are a set of single characters, which is one look,
# and stand before the ranges.
_RARE = r"[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SPACE = rf"[[^!-~]&&[[ \n\t\x0b\f\r\xa0]{_RARE}]]"
BLANK = rf"[[^!-~]&&[[ \t\x0b\f\r\xa0]{_RARE}]]"  # white space that stays on the line
NOT_EOL = r"[^\n\r\u2028\u2029]"

# Extensions whose comments can be masked, by comment style.
SLASH_COMMENT_EXTS = [".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".cpp", ".cs"]
HASH_COMMENT_EXTS = [".py"]
MARKUP_COMMENT_EXTS = [".html", ".xml"]

# Fixed value: how much of a file is looked at for a NUL.
BINARY_SNIFF_BYTES = 1024

# Marks placed around matches; text that already holds them is neutralised first.
MARK_OPEN = "\ue000"
MARK_CLOSE = "\ue001"


def trim_space(c: Column) -> Column:
    """Strip the full white space set (Spark's own ``trim`` strips only U+0020)."""
    return F.btrim(c, F.lit(WHITESPACE_CHARS))


def without_marks(c: Column) -> Column:
    return F.translate(c, MARK_OPEN + MARK_CLOSE, "\ufffd\ufffd")


def split_lines(c: Column) -> Column:
    """Split on LF only; a CR stays with its line."""
    return F.split(c, "\n", -1)


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def bytes_to_text(c: Column) -> Column:
    """Decode UTF-8, replacing malformed sequences."""
    return F.make_valid_utf8(c.cast("string"))


def is_binary(c: Column) -> Column:
    """True when a NUL byte occurs in the first 1,024 bytes."""
    head = F.substring(c.cast("binary"), 1, BINARY_SNIFF_BYTES)
    return F.locate("\x00", head) > 0


def mask_comments(text: Column, ext: Column) -> Column:
    """Blank out comments by file extension. String literals are not looked at, so ``//`` inside
    a string goes too; removing a block comment moves later lines up."""
    slash = F.regexp_replace(
        F.regexp_replace(text, f"//{NOT_EOL}*+", ""), r"/\*[\s\S]*?\*/", ""
    )
    hashes = F.regexp_replace(text, f"#{NOT_EOL}*+", "")
    markup = F.regexp_replace(text, r"<!--[\s\S]*?-->", "")
    return (
        F.when(ext.isin(SLASH_COMMENT_EXTS), slash)
        .when(ext.isin(HASH_COMMENT_EXTS), hashes)
        .when(ext.isin(MARKUP_COMMENT_EXTS), markup)
        .otherwise(text)
    )


def mask_strings(text: Column) -> Column:
    """Empty every string literal, one quote style after the other. The loops are possessive:
    the plain alternation-in-a-star form overflows the JVM stack on literals of a few KB."""
    for quote in ('"', "'", "`"):
        body = rf"[^{quote}\\]*+(?:\\{NOT_EOL}[^{quote}\\]*+)*+"
        text = F.regexp_replace(text, f"{quote}{body}{quote}", quote * 2)
    return text
