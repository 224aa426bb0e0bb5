"""Search patterns: written in the search dialect, run by Java's regex engine.

The dialect differs from Java's in what ``.``, ``$``, ``^``, ``\\b``, ``\\s`` and bare braces mean;
``compile_pattern`` rewrites those so that Spark's regex functions give the dialect's matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import NOT_EOL, SPACE, SPACE_INNER, split_lines

ANY_BUT_EOL = NOT_EOL
ASCII_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
NOT_ASCII_EDGE = r"(?:(?<!\w)(?!\w)|(?<=\w)(?=\w))"

_SPECIAL = re.compile(r"[.*+?^${}()|\[\]\\]")
_TOKEN = re.compile(
    r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|c[A-Za-z]|k<\w+>|[\s\S])"
    r"|\[\^?(?:\\[\s\S]|[^\]\\])*\]"
    r"|\{\d+(?:,\d*)?\}|\{|[.^$]"
)
_WORDLIKE = re.compile(r"\w(?:[ -~]*\w)?", re.ASCII)  # printable ASCII, a word character at both ends
_KEPT_ESCAPES = set("dDwWfnrt123456789")
_OUTSIDE = {
    r"\b": ASCII_EDGE, r"\B": NOT_ASCII_EDGE, r"\s": SPACE, r"\S": f"[^{SPACE_INNER}]",
    r"\v": r"\x0b", r"\0": r"\x00", ".": ANY_BUT_EOL, "{": r"\{",
}
_INSIDE = {r"\b": r"\x08", r"\s": SPACE_INNER, r"\S": f"[^{SPACE_INNER}]", r"\v": r"\x0b", r"\0": r"\x00"}


def _escape(token: str, table: dict[str, str]) -> str:
    if token in table:
        return table[token]
    letter = token[1]
    if len(token) > 2 or letter in _KEPT_ESCAPES or not letter.isalnum():
        return token
    return letter  # an escaped ordinary letter is that letter


def _char_class(token: str) -> str:
    if token == "[]":
        return r"(?!)"
    if token == "[^]":
        return r"[\s\S]"
    negated = token.startswith("[^")
    body = token[2 if negated else 1:-1]
    body = re.sub(
        r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|c[A-Za-z]|[\s\S])|[\[&]",
        lambda m: _escape(m[0], _INSIDE) if m[0][0] == "\\" else "\\" + m[0],
        body,
    )
    return f"[{'^' if negated else ''}{body}]"


def to_java_regex(pattern: str, multiline: bool = False) -> str:
    start, end = ("(?<!" + NOT_EOL + ")", "(?!" + NOT_EOL + ")") if multiline else (r"\A", r"\z")

    def rewrite(m: re.Match) -> str:
        token = m[0]
        if token == "^":
            return start
        if token == "$":
            return end
        if token[0] == "[":
            return _char_class(token)
        if token[0] == "\\":
            return _escape(token, _OUTSIDE)
        return _OUTSIDE.get(token, token)

    return _TOKEN.sub(rewrite, pattern)


@dataclass(frozen=True)
class CompiledPattern:
    """A checked Java regex, with the literal it came from when it is one."""

    regex: str
    literal: str | None
    plain: bool  # literal that byte comparison finds: no case folding, no word edges

    def count_in_text(self, text: Column) -> Column:
        """Matches over all lines of ``text``, without producing a row per line or match."""
        if self.literal is not None:
            if "\n" in self.literal:
                return F.lit(0)
            if self.plain:
                gap = F.length(text) - F.length(F.replace(text, F.lit(self.literal), F.lit("")))
                return F.call_function("div", gap, F.lit(len(self.literal))).cast("int")
            # every match is as long as the literal
            gap = F.length(text) - F.length(F.regexp_replace(text, self.regex, ""))
            return F.call_function("div", gap, F.lit(len(self.literal))).cast("int")
        return F.aggregate(
            split_lines(text),
            F.lit(0),
            lambda n, line: n + F.regexp_count(line, F.lit(self.regex)),
        )

    def in_text(self, text: Column) -> Column:
        """True when some line of ``text`` matches."""
        if self.literal is not None:
            if "\n" in self.literal:
                return F.lit(False)
            if self.plain:
                return text.contains(self.literal)
            return text.rlike(self.regex)
        return F.exists(split_lines(text), lambda line: line.rlike(self.regex))

    def in_line(self, line: Column) -> Column:
        if self.plain and self.literal is not None:
            return line.contains(self.literal)
        return line.rlike(self.regex)

    def first_line_no(self, text: Column) -> Column:
        """1-based number of the first line with a match; null when there is none."""
        hit = F.array_position(F.transform(split_lines(text), self.in_line), True)
        return F.nullif(hit, F.lit(0).cast("long")).cast("int")


def compile_pattern(
    pattern: str,
    *,
    regex_mode: bool = False,
    case_sensitive: bool = False,
    word_boundary: bool = False,
    multiline: bool = False,
) -> CompiledPattern:
    """Build the Java regex. Word edges wrap the whole pattern without grouping it, so ``a|b``
    becomes "edge a, or b edge". Raises ``ValueError`` for a pattern the engine refuses."""
    if pattern == "":
        raise ValueError("empty pattern")
    literal = None if regex_mode else pattern
    body = (
        to_java_regex(pattern, multiline)
        if regex_mode
        else _SPECIAL.sub(lambda m: "\\" + m[0], pattern)
    )
    if word_boundary and literal is not None and _WORDLIKE.fullmatch(pattern):
        # the same edges, looked for only where the literal stands
        body = rf"{body}(?!\w)(?<!\w{body})"
    elif word_boundary:
        body = ASCII_EDGE + body + ASCII_EDGE
    regex = body if case_sensitive else _folded(body, pattern)
    uncased = pattern.lower() == pattern.upper()
    compiled = CompiledPattern(
        regex, literal, literal is not None and not word_boundary and (case_sensitive or uncased)
    )
    _check(compiled.regex, pattern)
    return compiled


# an escape, a class, the opening of a group, or a letter that folds into or out of ASCII
_FOLDING = re.compile(r"\\[\s\S]|\[(?:\\[\s\S]|[^\]\\])*\]|\(\?<\w+>|\(\?[a-zA-Z-]*[:)]|[iskISK]")


def _folded(body: str, pattern: str) -> str:
    """A regex without regard to case. The dialect never folds a letter outside ASCII into one inside, as Java does for
    a few; so a pattern in ASCII folds within ASCII, and in others the letters in question do."""
    if pattern.isascii():
        return "(?i)" + body
    return "(?iu)" + _FOLDING.sub(lambda m: f"(?-u:{m[0]})" if len(m[0]) == 1 else m[0], body)


def _check(regex: str, pattern: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        # folds to a constant while planning: no job runs
        spark.sql("SELECT regexp_count('', :regex) AS n", args={"regex": regex}).head()
    except Exception as error:
        raise ValueError(f"invalid search pattern: {pattern!r}") from error
