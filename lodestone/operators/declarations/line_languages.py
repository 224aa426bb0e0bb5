"""Java, Kotlin and C#: every declaration is decided by its own line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.arrays import bind
from ...functions.text import trim_space
from .common import function, given, import_of, keyword_lines, kind_name, one_segment, specifier
from .heads import Head, is_dotted, is_identifier, rest_after, without_end, words

# The words of each language that open a declaration.
JAVA_TYPES = Head(("class", "interface", "enum", "record"), (("public", "protected", "private"),))
KOTLIN_ITEMS = Head(
    ("class", "interface", "object", "fun", "val", "var", "typealias"), (("public", "internal"),)
)
CSHARP_VISIBILITY = ("public", "internal")
CSHARP_TYPES = Head(("class", "interface", "enum", "struct", "record"), (CSHARP_VISIBILITY, ("partial",)))


def _starts(*sets: tuple[str, ...]) -> str:
    return "(?:" + "|".join(word for own in sets for word in own) + r")\b"


def _imported(source: Column, kind: Column | str, alias: Column | None = None) -> Column:
    return F.array(specifier(source), import_of(source, kind, alias))


def java_segments(text: Column) -> Column:
    return one_segment(keyword_lines(text, _starts(("import",), *JAVA_TYPES.before, JAVA_TYPES.kinds)))


def _java_path(path: Column) -> Column:
    """A dotted name, or words between dots with a star at the end."""
    stem = F.split(F.substr(path, F.lit(1), F.length(path) - 2), r"\.", -1)
    starred = path.endswith(".*") & F.forall(stem, lambda part: part.rlike(r"\A\w+\z"))
    return is_dotted(path) | starred


def java(line: Column, _state: Column) -> Column:
    def imported(code: Column) -> Column:
        def of(w: Column) -> Column:
            static = (F.size(w) == 3) & (F.try_element_at(w, F.lit(2)) == "static")
            path = F.element_at(w, -1)
            fits = ((F.size(w) == 2) | static) & _java_path(path)
            return F.when(fits, given(
                lambda v: _imported(v["source"], v["kind"]),
                source=path, kind=F.when(static, "import-static").otherwise("import"),
            ))

        return bind(words(code), of)

    return F.when(_spaced(line, "import"), imported(without_end(line, ";"))).otherwise(
        JAVA_TYPES.read(words(line), lambda h: F.array(kind_name(h["kind"], h["name"])))
    )


def _spaced(line: Column, word: str) -> Column:
    """Whether a line's first word is ``word`` and others follow."""
    rest = F.substr(line, F.lit(len(word) + 1))
    return line.startswith(word) & (trim_space(rest) != rest)


def kotlin_segments(text: Column) -> Column:
    return one_segment(keyword_lines(text, _starts(("import",), *KOTLIN_ITEMS.before, KOTLIN_ITEMS.kinds)))


def kotlin(line: Column, _state: Column) -> Column:
    def imported(w: Column) -> Column:
        renamed = (F.size(w) == 4) & (F.try_element_at(w, F.lit(3)) == "as")
        alias = F.when(renamed, F.try_element_at(w, F.lit(4)))
        fits = is_dotted(F.try_element_at(w, F.lit(2))) & ((F.size(w) == 2) | (renamed & is_identifier(alias)))
        return F.when(fits, given(
            lambda v: _imported(v["source"], "import", v["alias"]),
            source=F.try_element_at(w, F.lit(2)), alias=alias,
        ))

    def declared(h: Column) -> Column:
        return F.array(kind_name(h["kind"], h["name"]), F.when(h["kind"] == "fun", function(h["name"])))

    return bind(
        words(line),
        lambda w: F.when(F.element_at(w, 1) == "import", imported(w)).otherwise(KOTLIN_ITEMS.read(w, declared)),
    )


def csharp_segments(text: Column) -> Column:
    return one_segment(keyword_lines(text, _starts(("using",), CSHARP_VISIBILITY)))


def csharp(line: Column, _state: Column) -> Column:
    def used(code: Column) -> Column:
        def of(sides: Column) -> Column:
            alias = F.when(F.size(sides) == 2, trim_space(F.element_at(sides, 1)))
            source = trim_space(F.element_at(sides, -1))
            fits = is_dotted(source) & (alias.isNull() | is_identifier(alias))
            return F.when(fits, given(
                lambda v: _imported(v["source"], F.when(v["alias"].isNull(), "using").otherwise("using-alias"), v["alias"]),
                source=source, alias=alias,
            ))

        return bind(F.split(rest_after(code, F.lit("using")), "=", 2), of)

    def declared(h: Column) -> Column:
        visible = h["first"].isin(*CSHARP_VISIBILITY)
        return F.when(visible, F.array(kind_name(h["kind"], h["name"], h["first"])))

    return F.when(_spaced(line, "using"), used(without_end(line, ";"))).otherwise(
        CSHARP_TYPES.read(words(line), declared)
    )
