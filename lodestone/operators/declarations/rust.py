"""Rust: statements end at a semicolon; a declaration must open its statement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.arrays import bind
from ...functions.text import trim_space, unix_newlines
from .common import function, given, import_of, kind_name, one_segment, rx, specifier
from .heads import Head, is_identifier, without_end, words

# The words that open a declaration.
FUNCTIONS = Head(("fn",), (("async",),))
ITEMS = Head(("struct", "enum", "trait", "type", "mod", "const", "static"))
OPENERS = ("use", "extern", "pub", "async", "fn")


def rust_segments(text: Column) -> Column:
    # comment lines go only where no statement has begun: at the start and after a closing ";\n"
    code = F.regexp_replace(
        unix_newlines(text), rx(r"(\A|;\n)(?:<b>*//[^\n]*(?:\n|\z)|\n)++"), "$1"
    )
    statements = F.transform(F.split(code, "(?<=;)", -1), trim_space)
    return one_segment(F.filter(statements, lambda p: p.rlike(rf"^(?:{'|'.join(OPENERS)})\b")))


def _imported(source: Column, kind: str) -> Column:
    return given(lambda v: F.array(specifier(v["s"]), import_of(v["s"], kind)), s=source)


def _closed(stmt: Column) -> Column:
    """Imports: statements with their semicolon."""

    def of(w: Column) -> Column:
        used = (F.element_at(w, 1) == "use") & (F.size(w) > 1)
        crate = (
            (F.element_at(w, 1) == "extern") & (F.size(w) == 3) & (F.try_element_at(w, F.lit(2)) == "crate")
            & is_identifier(F.try_element_at(w, F.lit(3)))
        )
        path = F.array_join(F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), " ")
        return F.when(used, _imported(path, "use")).when(crate, _imported(F.element_at(w, -1), "extern-crate"))

    return bind(words(without_end(stmt, ";")), of)


def _open(stmt: Column) -> Column:
    """Public functions and items. The visibility is ``pub`` with all that its brackets hold."""
    end = F.when(stmt.startswith("pub("), F.instr(stmt, ")")).otherwise(F.lit(3))

    def of(parts: Column) -> Column:
        vis, rest = parts["vis"], parts["rest"]
        spaced = trim_space(rest) != rest

        def declared(w: Column) -> Column:
            open_fn = FUNCTIONS.read(
                w,
                lambda h: F.array(
                    function(h["name"], F.concat(h["name"], F.lit(", exported"))), kind_name("fn", h["name"], vis)
                ),
            )
            return F.coalesce(open_fn, ITEMS.read(w, lambda h: F.array(kind_name(h["kind"], h["name"], vis))))

        return F.when(spaced, bind(words(trim_space(rest)), declared))

    return given(of, vis=F.substr(stmt, F.lit(1), end), rest=F.substr(stmt, end + 1))


def rust(stmt: Column, _state: Column) -> Column:
    closed = stmt.startswith("use") | stmt.startswith("extern")
    return (
        F.when(closed, _closed(stmt))
        .when(stmt.startswith("pub"), _open(stmt))
        .otherwise(FUNCTIONS.read(words(stmt), lambda h: F.array(function(h["name"]))))
    )
