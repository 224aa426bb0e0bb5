"""A lexical scanner for JavaScript and TypeScript: a walk over the tokens of a text, in a Python function on Arrow batches.

Whether a quote, a slash or an angle bracket opens something depends on what stands around it. The state is a stack with one character for each open
construct, and what came before: a value, an operator, a keyword that a parenthesis follows. What comes out is plain code: without comments, with regular
expressions and markup as ``0``, with the code of placeholders and of markup in parentheses, and with a statement of its own for each declared variable.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.arrays import bind
from ...ship import ship_package

IDENTIFIER = r"[A-Za-z_$][\w$]*+"
STRING = (
    r"""(?:"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"""
    r"""|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`)"""
)
COMMENT = r"//[^\n]*+|/\*[\s\S]*?\*/"

# Words after which a value begins, and those whose parentheses hold a condition.
BEFORE_VALUES = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await", "default", "extends"}
BEFORE_CONDITIONS = {"if", "while", "for", "with"}
GOING_ON = {"in", "of", "instanceof", "as", "satisfies"}

#: Open constructs in which code stands: the file, brackets, the parentheses of a condition, a placeholder, braces in markup, a variable statement, an exported one.
_CODE = "c([{K$Jne"
#: Others: strings, template text, regular expression and class in one, line and block comment, tag, its strings, markup text, closing tag.
_VALUE, _VALUE_THEN_LINE, _OPERATOR, _DOT, _CONDITION, _EXPORT = "v", "V", "o", "d", "k", "X"
#: A comma in a variable statement, and one with a comment behind it, after which a name is declared.
_COMMA, _COMMA_THEN_COMMENT = "C", "D"

_TYPE_ARGUMENTS = r"<[\w$ \t.|&\[\]?:]*+,(?:[\w$ \t.,|&\[\]?:]++|<[^<>()=]*+>)*+>"
#: A comma with what may be the next declared name, or with the white space before a pattern; other commas are tokens of one character.
_FURTHER_NAME = rf",\s*+{IDENTIFIER}(?=[^\S\n]*+(?:=(?![=>])|!?:|[,;\n]|\Z))|,\s++(?=[{{\[])"
_TOKENS = (
    rf"\\[\s\S]|//|/\*|\*/|/>|</|\$\{{|=>|\.\.\.|\+\+|--|{_TYPE_ARGUMENTS}|<[A-Za-z_$][\w$.:-]*+(?!\s*+,|\s++extends\b)|<>"
    rf"|{_FURTHER_NAME}|[`\"'/<>{{}}()\[\],;.!\n*+-]|(?:\w|\$(?!\{{))++|[^\S\n]++|[^\s\w$\\`\"'/<>{{}}()\[\],;.!*+=-]++|[\s\S]"
)


def _balanced(depth: int) -> str:
    inner = "" if depth == 1 else f"|{_balanced(depth - 1)}"
    held = rf"(?:[^(){{}}\[\]]++{inner})*+"
    return rf"\({held}\)|\[{held}\]|\{{{held}\}}"


#: A variable statement with a comma outside brackets, or with brackets too deep to tell.
_SEVERAL = rf"\b(?:const|let|var)\s(?:[^,;(){{}}\[\]]++|{_balanced(3)})*+[,(\[{{]"


def needs_scan(raw: Column, markup: Column) -> Column:
    """Whether a text may hold what simple expressions get wrong: a slash that is no comment's, markup, a placeholder with braces or templates inside, several
    names in one statement. The first such place is always seen, for up to there strings and comments are read rightly."""
    bare = F.regexp_replace(raw, rf"(?=[\"'`/])(?:{STRING}|{COMMENT})", "0")
    return raw.rlike(r"\$\{[^}]*[{`]") | bind(
        bare, lambda t: t.contains("/") | t.rlike(_SEVERAL) | (markup & t.rlike(r"<[A-Za-z_$>]"))
    )


_TOKEN = re.compile(_TOKENS, re.ASCII)
_BLANK = " \t\n\r\f\v"
_WORD = re.compile(r"[\w$]", re.ASCII)
_NAME_AFTER_COMMA = re.compile(r",\s*[A-Za-z_$]", re.ASCII)
_LINE_AFTER_COMMA = re.compile(r",[^\S\n]*\n", re.ASCII)
_ARGUMENTS = re.compile("<[^\n\r\x85\u2028\u2029]*>")
_TAG = re.compile("<[A-Za-z_$]")
_BRACKETS = {")": "(K", "]": "[", "}": "{$J"}


def _in_code(stack: str, prev: str, t: str, markup: bool) -> tuple[str, str, str]:
    """The stack, what came before and the plain code, after token ``t`` in code."""
    first, value, top = t[0], prev in "vV", stack[-1:]
    if _WORD.match(t) and t != "${":
        # a new line ends a variable statement, unless the word goes on with the value before it
        ended = stack.rstrip("ne") if prev == _VALUE_THEN_LINE and t not in GOING_ON else stack
        out = t
        if prev == _COMMA_THEN_COMMENT and not first.isdigit():
            out = ("; export const " if top == "e" else "; const ") + t
        if prev != _DOT:
            if t in ("const", "let", "var") and top not in ("(", "K"):
                return ended + ("e" if prev == _EXPORT else "n"), _OPERATOR, out
            if t == "export" or (t == "declare" and prev == _EXPORT):
                return ended, _EXPORT, out
            if t in BEFORE_CONDITIONS:
                return ended, _CONDITION, out
            if t in BEFORE_VALUES or t in ("const", "let", "var"):
                return ended, _OPERATOR, out
        return ended, _VALUE, out
    if first in _BLANK:
        return stack, _VALUE_THEN_LINE if t == "\n" and prev == _VALUE else prev, t
    if first == "," and len(t) > 1:
        out = ("; const " if top == "n" else "; export const " if top == "e" else ",") + t[1:]
        return stack, _VALUE if _NAME_AFTER_COMMA.match(t) else _OPERATOR, out
    if first in "\"'`":
        ended = stack.rstrip("ne") if prev == _VALUE_THEN_LINE else stack
        return ended + t, _OPERATOR, t
    if t == "(":
        return stack + ("K" if prev == _CONDITION else "("), _OPERATOR, t
    if t in ("[", "{"):
        return stack + t, _OPERATOR, t
    if t in _BRACKETS:
        outside = stack.rstrip("ne")
        around = outside[-1:]
        closed = outside[:-1] if around and around in _BRACKETS[t] else outside
        if t == "}":
            return closed, _OPERATOR, ")+`" if around == "$" else ")" if around == "J" else t
        return closed, _OPERATOR if t == ")" and around == "K" else _VALUE, t
    if t == ";":
        return stack.rstrip("ne"), _OPERATOR, t
    if t == ".":
        return stack, _DOT, t
    if t == "," and top in ("n", "e"):
        return stack, _COMMA, t
    if t in ("//", "/*"):
        return stack + ("L" if t == "//" else "B"), prev, ""
    if t in ("/", "/>") and not value:
        return stack + "/", _OPERATOR, "0"
    if t in ("++", "--", "!") and value:
        return stack, _VALUE, t
    if first == "<" and t != "<>" and _ARGUMENTS.fullmatch(t):
        return stack, prev, t
    if first == "<" and (t == "<>" or (len(t) > 1 and t[1] not in "<>/")):
        if markup and not value and prev != _DOT:
            return stack + ("x" if t == "<>" else "<"), _OPERATOR, "0"
        return stack, _OPERATOR if t == "<>" else _VALUE, t
    return stack, _OPERATOR, t


def _elsewhere(stack: str, prev: str, t: str) -> tuple[str, str, str]:
    """The same in strings, comments, regular expressions and markup."""
    top, pop = stack[-1], stack[:-1]
    out = t if top in "\"'`" else ""
    breaks = t == "\n" or (t[0] == "," and _LINE_AFTER_COMMA.match(t) is not None)  # ends what can't go over a line
    if top in "L/R" and "\n" in t and t[0] != "\\":
        out = t.removeprefix(",")
    if top in "\"'":
        if t == top:
            return pop, _VALUE, out
        return (pop, _VALUE_THEN_LINE, out) if breaks else (stack, prev, out)
    if top == "`":
        if t == "`":
            return pop, _VALUE, out
        return (stack + "$", _OPERATOR, "`+(") if t == "${" else (stack, prev, out)
    if top == "/":
        if t == "[":
            return stack + "R", prev, out
        if breaks:
            return pop, _VALUE_THEN_LINE, out
        return (pop, _VALUE, out) if "/" in t and t[0] != "\\" else (stack, prev, out)
    if top == "R":
        if t == "]":
            return pop, prev, out
        return (stack[:-2], _VALUE_THEN_LINE, out) if breaks else (stack, prev, out)
    if top in "LB":
        if not (breaks if top == "L" else t == "*/"):
            return stack, prev, out
        after = _COMMA_THEN_COMMENT if prev == _COMMA else _VALUE_THEN_LINE if top == "L" and prev == _VALUE else prev
        return pop, after, " " if top == "B" else out
    if t == "{" and top in "<x":
        return stack + "J", _OPERATOR, "("
    if top == "<":
        if t == "/>":
            return pop, _VALUE, out
        opened = {">": pop + "x", '"': stack + "q", "'": stack + "s", "//": stack + "L", "/*": stack + "B"}
        return opened.get(t, stack), prev, out
    if top in "qs":
        return (pop if t == ('"' if top == "q" else "'") else stack), prev, out
    if top == "x":
        if t in ("</", "<>"):
            return (pop + "E" if t == "</" else stack + "x"), prev, out
        return (stack + "<" if _TAG.match(t) else stack), prev, out
    return (pop, _VALUE, out) if t == ">" else (stack, prev, out)


_NAMED_BY = frozenset("$_0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MEANT = frozenset([*BEFORE_VALUES, *BEFORE_CONDITIONS, "const", "let", "var", "export", "declare", "${"])


def scan(text: str, markup: bool) -> str:
    """The text as plain code; ``markup`` says whether it may hold markup."""
    stack, top, prev, parts = "c", "c", _OPERATOR, []
    for t in _TOKEN.findall(text):
        if top in _CODE:
            # most tokens are blanks, and words without a meaning of their own
            if t == " ":
                parts.append(t)
                continue
            if t[0] in _NAMED_BY and prev in "vodkXC" and t not in _MEANT:
                prev = _VALUE
                parts.append(t)
                continue
            stack, prev, out = _in_code(stack, prev, t, markup)
        else:
            stack, prev, out = _elsewhere(stack, prev, t)
        top = stack[-1]
        parts.append(out)
    return "".join(parts)


@cache
def _scanned():
    def run(texts: pa.Array, markup: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), markup.to_pylist(), strict=True)
        return pa.array([None if text is None else scan(text, bool(may)) for text, may in pairs], pa.string())

    return F.arrow_udf(run, "string")


def with_plain_code(files: DataFrame, column: str) -> DataFrame:
    """``files`` with the texts of scripts as plain code in ``column``; only those that need it go through the scanner, others stay as they are."""
    ship_package(files.sparkSession)
    raw, markup = F.col("content"), F.col("ext") != ".ts"
    asked = F.when((F.col("lang") == "script") & needs_scan(raw, markup), F.make_valid_utf8(raw))
    return files.withColumn(column, F.coalesce(_scanned()(asked, markup), raw))
