"""Shared parts of the declaration extractors.

A language gives two expressions: ``segments``, which cuts a text into pieces (lines, statements or
tokens) inside its row, and ``declared``, which builds the declaration structs of one piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.arrays import bind
from ...functions.text import BLANK, SPACE, trim_space, unix_newlines

NAME = r"[A-Za-z_]\w*"
DOTTED = r"[A-Za-z_][\w.]*"

_NAMES_TYPE = "array<struct<name:string,alias:string>>"
FIELDS = {
    "section": "string",
    "kind": "string",
    "source": "string",
    "name": "string",
    "alias": "string",
    "names": _NAMES_TYPE,
    "default_name": "string",
    "namespace": "string",
    "type_only": "boolean",
    "visibility": "string",
    "detail": "string",
    "rendered": "string",
}
DECL_COLUMNS = ["corpus_id", "path", "lang", "ord", *FIELDS]
DECL_TYPE = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"


def rx(pattern: str) -> str:
    """Fill in the wide white space class: ``<s>`` any, ``<b>`` staying on the line."""
    return pattern.replace("<s>", SPACE).replace("<b>", BLANK)


def group(text: Column, pattern: str, index: int) -> Column:
    """A capture group, null when there is no match or the group took no part."""
    return bind(F.regexp_extract(text, rx(pattern), index), lambda v: F.when(v != "", v))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern)), F.lit(0))


def decl(section: str, rendered: Column, **values: Column | str) -> Column:
    fixed = {"section": section, "rendered": rendered, **values}
    parts = []
    for field, kind in FIELDS.items():
        value = fixed.get(field)
        if value is None:
            parts.append(F.expr(f"CAST(NULL AS {kind}) AS {field}"))
        else:
            parts.append((F.lit(value) if isinstance(value, str) else value).alias(field))
    return F.struct(*parts)


def given(body: Callable[[Column], Column], **values: Column) -> Column:
    """Evaluate the named values once and hand them to ``body`` as a struct."""
    return bind(F.struct(*[value.alias(name) for name, value in values.items()]), body)


def specifier(source: Column) -> Column:
    return decl("specifier", source, source=source)


def function(name: Column, rendered: Column | None = None, **values: Column | str) -> Column:
    return decl("function", name if rendered is None else rendered, name=name, **values)


def kind_name(kind: Column | str, name: Column, visibility: Column | None = None) -> Column:
    """An export rendered from its kind, name and visibility."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    parts = [F.concat(F.lit("kind="), kind), F.concat(F.lit("name="), name)]
    extra = {}
    if visibility is not None:
        parts.append(F.concat(F.lit("vis="), visibility))
        extra["visibility"] = visibility
    return decl("export", F.concat_ws(", ", *parts), kind=kind, name=name, **extra)


def import_of(source: Column, kind: Column | str, alias: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    parts = [quoted_from(source), F.concat(F.lit("kind="), kind)]
    extra = {}
    if alias is not None:
        parts.append(F.concat(F.lit("alias="), alias))
        extra["alias"] = alias
    return decl("import", F.concat_ws(", ", *parts), kind=kind, source=source, **extra)


def quoted_from(source: Column) -> Column:
    return F.concat(F.lit('from "'), source, F.lit('"'))


def render_names(label: str, names: Column) -> Column:
    """``label={a, b as c}``, null for an empty list so that ``concat_ws`` leaves it out."""
    shown = F.transform(
        names, lambda n: F.concat(n["name"], F.coalesce(F.concat(F.lit(" as "), n["alias"]), F.lit("")))
    )
    return F.when(
        F.size(names) > 0, F.concat(F.lit(label + "={"), F.array_join(shown, ", "), F.lit("}"))
    )


def comma_items(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ",", -1), trim_space), lambda p: p != "")


def no_decls() -> Column:
    return F.array().cast(f"array<{DECL_TYPE}>")


def keyword_lines(text: Column, keywords: str) -> Column:
    """The trimmed lines that begin with one of ``keywords`` (a regex), in order.

    One pass of one expression pulls out the few lines that can hold a declaration, so the rest of
    the text is never exploded. Comment lines cannot begin with a keyword.
    """
    lines = F.regexp_extract_all(
        unix_newlines(text), F.lit(rx(rf"(?md)^<b>*(?:{keywords})[^\n]*")), F.lit(0)
    )
    return F.transform(lines, trim_space)


def one_segment(pieces: Column) -> Column:
    return F.array(segment(F.lit(""), pieces))


def segment(state: Column, pieces: Column) -> Column:
    """Pieces that share a block state."""
    return F.struct(state.alias("state"), pieces.alias("pieces"))
