"""Pattern matches: counts per file, one row per match, matches regrouped per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, running_starts
from ..functions.patterns import CompiledPattern
from ..functions.text import MARK_CLOSE, MARK_OPEN, split_lines, without_marks

DEFAULT_SNIPPET = 50


def explode_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """One row per line, numbered from 1; the text column itself is dropped."""
    return _exploded_lines(files, split_lines(F.col(text)), text)


def _exploded_lines(files: DataFrame, lines: Column, text: str) -> DataFrame:
    """A row for each of ``lines``. For a plain ``posexplode`` Spark infers a filter on the array's size, for which it would make the text and cut it once more."""
    keep = [c for c in files.columns if c != text]
    rows = files.select(*keep, F.posexplode_outer(lines).alias("line_pos", "line")).filter(F.col("line").isNotNull())
    return rows.select(*keep, (F.col("line_pos") + 1).alias("line_no"), "line")


def match_counts(files: DataFrame, pattern: CompiledPattern, text: str = "content") -> DataFrame:
    """Files with at least one match and their ``n_matches``. Counted inside each row: no match
    rows and no shuffle. The generator drops files without a match, so that the count, and what the
    text is made from, is evaluated once; a filter would be a second place to evaluate it."""
    keep = [c for c in files.columns if c != text]
    some = bind(pattern.count_in_text(F.col(text)), lambda n: F.when(n > 0, F.array(n)))
    return files.select(*keep, F.explode(some).alias("n_matches"))


def line_matches(line: Column, pattern: CompiledPattern, snippet: int = DEFAULT_SNIPPET) -> Column:
    """All matches of a line as an array of ``(match_start, match_end, snippet)``.

    Matches are marked in place by one replacement; cutting the marked line at the marks gives the
    pieces whose running lengths are the offsets. Zero-width matches come out like any other. A
    snippet is put together from the ends of the pieces around its match: every piece but the last
    has a character, so as many pieces as the context has characters are enough, and the work is
    in proportion to the line, however long it is.
    """
    context = snippet or DEFAULT_SNIPPET
    marked = F.regexp_replace(without_marks(line), F.lit(pattern.regex), F.lit(f"{MARK_OPEN}$0{MARK_CLOSE}"))

    def of(pieces: Column) -> Column:
        clean = F.transform(pieces, lambda p: F.replace(p, F.lit(MARK_CLOSE), F.lit("")))
        held = F.struct(
            running_starts(F.transform(clean, F.length)).alias("starts"),
            F.transform(clean, lambda p: F.right(p, F.lit(context))).alias("tails"),
            F.transform(clean, lambda p: F.left(p, F.lit(context))).alias("heads"),
        )

        def match(h: Column, piece: Column, i: Column) -> Column:
            text = F.substring_index(piece, MARK_CLOSE, 1)
            start = F.get(h["starts"], i + 1)
            before = F.array_join(F.slice(h["tails"], F.greatest(i + 2 - context, F.lit(1)), F.least(i + 1, F.lit(context))), "")
            after = F.array_join(F.slice(h["heads"], i + 3, F.lit(context)), "")
            rest = F.left(F.substr(piece, F.length(text) + 2), F.lit(context))
            return F.struct(
                start.alias("match_start"),
                (start + F.length(text)).alias("match_end"),
                F.concat(
                    F.right(before, F.lit(context)), text, F.left(F.concat(rest, after), F.lit(context))
                ).alias("snippet"),
            )

        def only(before: Column, piece: Column) -> Column:
            cut = F.substring_index(piece, MARK_CLOSE, 1)
            return bind(cut, lambda text: F.array(F.struct(
                F.length(before).alias("match_start"),
                (F.length(before) + F.length(text)).alias("match_end"),
                F.concat(F.right(before, F.lit(context)), text, F.left(F.substr(piece, F.length(text) + 2), F.lit(context))).alias("snippet"),
            )))

        several = bind(
            held,
            lambda h: F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda p, i: match(h, p, i)),
        )
        # most lines with a match have one: its context is in the two pieces
        return F.when(F.size(pieces) == 2, only(F.get(pieces, F.lit(0)), F.get(pieces, F.lit(1)))).otherwise(several)

    return bind(F.split(marked, MARK_OPEN, -1), of)


def find_matches(
    files: DataFrame,
    pattern: CompiledPattern,
    snippet: int = DEFAULT_SNIPPET,
    text: str = "content",
    with_line: bool = False,
) -> DataFrame:
    """One row per match: ``line_no``, ``match_ord``, ``match_start``, ``match_end``, ``snippet``,
    and the ``line`` if asked for, beside the file's own columns. Narrow transformations only."""
    keep = [c for c in files.columns if c != text]
    lines = split_lines(F.col(text))
    if pattern.literal is not None:
        # the text is made once: a filter would be a second place to make it
        lines = bind(F.col(text), lambda body: F.when(pattern.in_text(body), split_lines(body)))
    line = ["line"] if with_line else []
    return (
        _exploded_lines(files, lines, text)
        .filter(pattern.in_line(F.col("line")))
        .select(*keep, "line_no", *line, F.posexplode_outer(line_matches(F.col("line"), pattern, snippet)).alias("at", "m"))
        .filter(F.col("at").isNotNull())
        .select(*keep, "line_no", (F.col("at") + 1).alias("match_ord"), *line, "m.match_start", "m.match_end", "m.snippet")
    )


def file_matches(text: Column, pattern: CompiledPattern, snippet: int = DEFAULT_SNIPPET) -> Column:
    """All matches of a text in document order, as an array of ``(line_no, line, match_start,
    match_end, snippet)`` made inside the row: nothing is exploded and regrouped."""

    def of(line: Column, n: Column) -> Column:
        found = F.transform(
            line_matches(line, pattern, snippet),
            lambda m: F.struct(
                (n + 1).alias("line_no"), line.alias("line"), m["match_start"].alias("match_start"),
                m["match_end"].alias("match_end"), m["snippet"].alias("snippet"),
            ),
        )
        return F.when(pattern.in_line(line), found)

    return F.flatten(F.filter(F.transform(split_lines(text), of), lambda m: m.isNotNull()))


def group_matches(matches: DataFrame) -> DataFrame:
    """Match rows back to one row per file, matches in document order."""
    fields = [c for c in ("line_no", "match_ord", "line", "match_start", "match_end", "snippet") if c in matches.columns]
    keys = [c for c in matches.columns if c not in fields]
    listed = F.array_sort(F.collect_list(F.struct(*fields)))
    return matches.groupBy(*keys).agg(listed.alias("matches")).withColumn(
        "matches", F.transform("matches", lambda m: m.dropFields("match_ord"))
    )


def head_per_file(results: DataFrame, shown: int = 10) -> DataFrame:
    """The first ``shown`` matches of each file and how many more there are."""
    total = F.size("matches")
    return results.withColumns(
        {
            "overflow": F.greatest(total - shown, F.lit(0)),
            "matches": F.slice("matches", 1, shown),
        }
    )
