"""Imports, exports, functions and module specifiers of source files, by language.

One scan serves all languages and nothing is shuffled: the extension picks the expression that cuts a text into
pieces, the declarations of each piece are built from its own short text, and repeated ones are merged, all inside
the file's row. Specifiers of scripts are read off the whole text, without pieces or declarations.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.arrays import bind
from ...functions.paths import SCRIPT_EXTS
from .common import DECL_COLUMNS, DECL_TYPE, no_decls
from .go import go, go_segments
from .line_languages import (
    csharp, csharp_segments, java, java_segments, kotlin, kotlin_segments,
)
from .python import python, python_segments
from .rust import rust, rust_segments
from .scanner import with_plain_code
from .script import script, script_segments, script_specifiers

Segments = Callable[[Column, Column], Column]
Declared = Callable[[Column, Column], Column]



def _of_text(segments: Callable[[Column], Column]) -> Segments:
    return lambda text, _plain: segments(text)


LANGUAGES: dict[str, tuple[list[str], Segments, Declared]] = {
    "script": (SCRIPT_EXTS, script_segments, script),
    "python": ([".py"], _of_text(python_segments), python),
    "rust": ([".rs"], _of_text(rust_segments), rust),
    "go": ([".go"], _of_text(go_segments), go),
    "java": ([".java"], _of_text(java_segments), java),
    "kotlin": ([".kt", ".kts"], _of_text(kotlin_segments), kotlin),
    "csharp": ([".cs"], _of_text(csharp_segments), csharp),
}

#: Languages with an expression that gives a text's specifiers without its pieces and declarations.
SPECIFIERS: dict[str, Segments] = {"script": script_specifiers}


def language(ext: Column, names: list[str] | None = None) -> Column:
    return reduce(
        lambda col, name: col.when(ext.isin(LANGUAGES[name][0]), name),
        names or LANGUAGES,
        F.when(F.lit(False), F.lit(None)),
    )


# Building these expressions takes longer than planning them, so a session builds each once.
_built: WeakKeyDictionary[SparkSession, dict[tuple[str, str], Column]] = WeakKeyDictionary()


def _once(files: DataFrame, name: str, what: str, build: Callable[[], Column]) -> Column:
    known = _built.setdefault(files.sparkSession, {})
    if (name, what) not in known:
        known[name, what] = build()
    return known[name, what]


def _pieces(files: DataFrame, name: str) -> Column:
    """All pieces of a file in order, each with the state of its segment."""

    def build() -> Column:
        segments = LANGUAGES[name][1](F.col("content"), F.col("plain"))
        return F.flatten(
            F.transform(
                segments,
                lambda s: F.transform(s["pieces"], lambda p: F.struct(s["state"].alias("state"), p.alias("piece"))),
            )
        )

    return _once(files, name, "pieces", build)


def _declared(files: DataFrame, name: str) -> Column:
    def build() -> Column:
        declare = LANGUAGES[name][2]
        built = F.transform("pieces", lambda p: F.coalesce(declare(p["piece"], p["state"]).cast(f"array<{DECL_TYPE}>"), no_decls()))
        return F.filter(F.flatten(built), lambda d: d.isNotNull())

    return _once(files, name, "declared", build)


def _specifiers(files: DataFrame, name: str) -> Column:
    def build() -> Column:
        if name in SPECIFIERS:
            return SPECIFIERS[name](F.col("content"), F.col("plain"))
        found = F.filter(_declared(files, name), lambda d: d["section"] == "specifier")
        return F.transform(found, lambda d: d["source"])

    return _once(files, name, "specifiers", build)


def _by_language(names: list[str], value: Callable[[str], Column]) -> Column:
    if len(names) == 1:
        return value(names[0])
    return reduce(
        lambda col, name: col.when(F.col("lang") == name, value(name)),
        names[1:],
        F.when(F.col("lang") == names[0], value(names[0])),
    )


def _chosen(languages: list[str] | None) -> list[str]:
    names = list(languages or LANGUAGES)
    if unknown := set(names) - set(LANGUAGES):
        raise ValueError(f"unknown languages: {', '.join(sorted(unknown))}")
    return names


def _in_languages(files: DataFrame, names: list[str]) -> DataFrame:
    exts = [e for name in names for e in LANGUAGES[name][0]]
    chosen = files.filter(F.col("ext").isin(exts)).select("corpus_id", "path", "ext", language(F.col("ext"), names).alias("lang"), "content")
    return with_plain_code(chosen, "plain") if "script" in names else chosen


def _cut(files: DataFrame, names: list[str]) -> DataFrame:
    """One row a file with all its pieces."""
    pieces = _by_language(names, lambda name: _pieces(files, name))
    return _in_languages(files, names).select("corpus_id", "path", "lang", pieces.alias("pieces"))


def _first_of_each(decls: Column) -> Column:
    """The declarations without repeated ones, the first of each kept in its place. Where all hashes differ none is repeated; only
    another file gets keys that spell its declarations out, and is sorted."""

    def merged(own: Column) -> Column:
        placed = F.transform(own, lambda d, i: F.struct(F.to_json(d).alias("key"), i.alias("at"), d.alias("d")))
        fresh = bind(
            F.array_sort(placed),
            lambda ordered: F.filter(ordered, lambda x, i: (i == 0) | (x["key"] != F.get(ordered, i - 1)["key"])),
        )
        firsts = F.array_sort(F.transform(fresh, lambda x: F.struct(x["at"].alias("at"), x["d"].alias("d"))))
        return F.transform(firsts, lambda x: x["d"])

    hashes = lambda own: F.transform(own, lambda d: F.xxhash64(d))
    return bind(decls, lambda own: F.when(F.size(F.array_distinct(hashes(own))) == F.size(own), own).otherwise(merged(own)))


def _opened(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """A row for each element of an array, with its place. For a plain ``posexplode`` Spark infers a filter on the array's size, which it would
    work out by building the whole array once more."""
    return rows.select(*keys, F.posexplode_outer(column).alias("ord", name)).filter(F.col(name).isNotNull())


def extract_lists(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Rows ``(corpus_id, path, lang, decls)``: the distinct declarations and specifiers of each file in first-seen order, in one array."""
    names = _chosen(languages)
    keys = ["corpus_id", "path", "lang"]
    decls = _by_language(names, lambda name: _declared(files, name))
    return _cut(files, names).select(*keys, decls.alias("decls")).select(*keys, _first_of_each(F.col("decls")).alias("decls"))


def extract_all(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Distinct declarations and specifiers (``section`` import, export, function, specifier) per
    file; ``ord`` grows in first-seen order within a file."""
    keys = ["corpus_id", "path", "lang"]
    rows = _opened(extract_lists(files, languages), keys, "decls", "d")
    return rows.select(*keys, F.col("ord").cast("long"), "d.*").select(*DECL_COLUMNS)


def extract_declarations(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    return extract_all(files, languages).filter(F.col("section") != "specifier")


def extract_specifiers(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Distinct ``(corpus_id, path, ord, specifier)``, ``ord`` growing in first-seen order."""
    names = _chosen(languages)
    rows = _in_languages(files, names)
    if not SPECIFIERS.keys() >= set(names):
        rows = rows.select("*", _by_language(names, lambda name: F.lit(None) if name in SPECIFIERS else _pieces(files, name)).alias("pieces"))
    found = F.array_distinct(_by_language(names, lambda name: _specifiers(files, name)))
    rows = _opened(rows.select("corpus_id", "path", found.alias("found")), ["corpus_id", "path"], "found", "specifier")
    return rows.select("corpus_id", "path", F.col("ord").cast("long").alias("ord"), "specifier")


__all__ = [
    "DECL_COLUMNS", "LANGUAGES", "extract_all", "extract_declarations", "extract_lists", "extract_specifiers",
]
