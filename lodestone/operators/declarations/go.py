"""Go: lines, plus the state of ``import (``, ``const (``, ``var (`` and ``type (`` blocks.

The state of a line is the last block opener or closer above it. Marking those lines and cutting
the text at the marks gives segments that each hold one state, so no window over lines is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.arrays import bind
from ...functions.text import MARK_OPEN, split_lines, trim_space, unix_newlines, without_marks
from .common import function, given, import_of, kind_name, no_decls, rx, segment, specifier
from .heads import Head, identifier, rest_after, words

# The words that open a block or a declaration.
VALUES = ("const", "var", "type")
LONE = Head(VALUES)
_BLOCK = f"(?:{'|'.join(('import', *VALUES))})"


def go_segments(text: Column) -> Column:
    opener = rf"<b>*{_BLOCK}<b>*\(<b>*$"
    marked = F.regexp_replace(
        without_marks(unix_newlines(text)), rx(rf"(?md)^(?={opener}|<b>*\))"), MARK_OPEN
    )

    def cut(part: Column) -> Column:
        # a part begins with its opener, with a closing bracket, or with the text
        head = trim_space(F.substring_index(part, "\n", 1))
        word = trim_space(F.substring_index(head, "(", 1))
        opens = head.endswith("(") & word.isin("import", *VALUES) & (F.length(head) > F.length(word))
        lines = F.transform(split_lines(part), trim_space)
        return segment(
            F.when(opens, word).otherwise(F.lit("")),
            F.filter(lines, lambda p: (p != "") & ~p.startswith("//") & p.rlike(r"^[A-Za-z_0-9.\"]")),
        )

    return F.transform(F.split(marked, MARK_OPEN, -1), cut)


def _imports(line: Column, in_block: bool) -> Column:
    """An import: what stands before the first quoted text says whether it has another name."""

    def of(quoted: Column) -> Column:
        before, source = F.element_at(quoted, 1), F.try_element_at(quoted, F.lit(2))
        spaced = trim_space(before) != before
        closed = (F.size(quoted) > 2) & (source != "")
        if not in_block:
            closed = closed & (F.size(quoted) == 3) & (F.element_at(quoted, -1) == "") & spaced

        def named(w: Column) -> Column:
            lead = 0 if in_block else 1
            alias = F.try_element_at(w, F.lit(lead + 1))
            bare = F.size(w) == lead
            other = (F.size(w) == lead + 1) & spaced & ((alias == ".") | alias.rlike(r"\A\w+\z"))
            fits = closed & (bare | other)
            if not in_block:
                fits = fits & (F.try_element_at(w, F.lit(1)) == "import")
            return F.when(
                fits,
                given(
                    lambda v: F.array(specifier(v["source"]), import_of(v["source"], "import", v["alias"])),
                    source=source, alias=F.when(other, alias),
                ),
            )

        # an empty text has no words
        return bind(F.filter(words(trim_space(before)), lambda w: w != ""), named)

    return bind(F.split(line, '"', -1), of)


def _export(kind: Column | str, name: Column) -> Column:
    """Names in capitals are exported."""
    return F.when(F.substr(name, F.lit(1), F.lit(1)).between("A", "Z"), kind_name(kind, name))


def _func(line: Column) -> Column:
    rest = rest_after(line, F.lit("func"))

    def named(text: Column) -> Column:
        def of(name: Column) -> Column:
            called = rest_after(text, name).startswith("(")
            return F.when(called, F.array(function(name), _export("func", name)))

        return bind(identifier(text), of)

    received = lambda r: F.when(r.startswith("("), trim_space(F.substr(r, F.instr(r, ")") + 1))).otherwise(r)
    return bind(bind(rest, received), named)


def go(line: Column, state: Column) -> Column:
    entry = bind(identifier(line), lambda name: F.when(name.isNotNull(), F.array(_export(state, name))).otherwise(no_decls()))
    return (
        F.when(state == "import", F.coalesce(_imports(line, True), _others(line)))
        .when(state.isin(*VALUES), F.coalesce(_imports(line, False), entry))
        .otherwise(F.coalesce(_imports(line, False), _others(line)))
    )


def _others(line: Column) -> Column:
    def of(w: Column) -> Column:
        lone = LONE.read(w, lambda h: F.array(_export(h["kind"], h["name"])))
        return F.when((F.element_at(w, 1) == "func") & (F.size(w) >= 2), _func(line)).otherwise(lone)

    return bind(words(line), of)
