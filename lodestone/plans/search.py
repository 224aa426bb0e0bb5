"""Search end to end: predicates, text preparation, matches, order, limit, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.paths import format_size, normalize_path
from ..functions.patterns import CompiledPattern, compile_pattern
from ..operators import matching, predicates, ranking
from ..operators.numbering import numbered
from ..operators.packing import in_order
from ..sources.sinks import iso_utc, json_document, result_json
from ..sources.tables import FILE_COLUMNS, FILE_KEYS, describe_files
from .options import SearchOptions

# Fixed value: matches shown per file in grouped text.
SHOWN_PER_FILE = 10


def pattern_of(options: SearchOptions) -> CompiledPattern:
    return compile_pattern(
        options.pattern,
        regex_mode=options.regex_mode,
        case_sensitive=options.case_sensitive,
        word_boundary=options.word_boundary,
        multiline=options.multiline,
    )


def select_files(files: DataFrame, options: SearchOptions) -> DataFrame:
    """All metadata predicates; they run before the content is looked at."""
    if options.search_path:
        files = below(files, options.search_path)
    files = predicates.prune_default_dirs(files)
    files = predicates.exclude_names(files, options.exclude_patterns)
    files = predicates.max_depth(files, options.max_depth)
    files = predicates.size_between(files, options.min_size, options.max_size)
    files = predicates.modified_between(files, options.modified_after, options.modified_before)
    files = predicates.ext_not_in(files, options.exclude_extensions)
    return predicates.ext_in(files, options.extensions)


def below(files: DataFrame, directory: str) -> DataFrame:
    """The files below a directory, described from there: what lies above it counts for nothing."""
    root = directory.rstrip("/") or "/"
    inside = files.filter(predicates.under_root(F.col("path"), root)).withColumn("root", F.lit(root))
    return describe_files(inside, *[c for c in files.columns if c not in FILE_COLUMNS])


def searchable(files: DataFrame, options: SearchOptions) -> DataFrame:
    """The files to search with their prepared text in ``content``."""
    chosen = select_files(files, options)
    if not options.include_binary:
        if "is_binary" in chosen.columns:
            chosen = chosen.filter(~F.col("is_binary"))
        else:
            chosen = chosen.filter(~T.is_binary(F.col("content")))
    return chosen.select(*FILE_COLUMNS, prepared_text(options).alias("content"))


def prepared_text(options: SearchOptions) -> Column:
    """``content`` with what the options leave out masked."""
    body: Column = F.col("content")
    if options.exclude_comments:
        body = T.mask_comments(body, F.col("ext"))
    if options.exclude_strings:
        body = T.mask_strings(body)
    return body


def ranked_files(files: DataFrame, options: SearchOptions) -> DataFrame:
    """The limited files in order, with ``n_matches`` and no match rows."""
    pattern, texts = pattern_of(options), searchable(files, options)
    if options.sort_by == "lineNumber":
        texts = texts.withColumn("first_line", pattern.first_line_no(F.col("content")))
    counted = matching.match_counts(texts, pattern)
    return ranking.top_files(counted, options.sort_by, options.max_results)


def _winners(files: DataFrame, options: SearchOptions, gapless: bool = True) -> DataFrame:
    """Narrow rows of the limited files with their ``place`` in the order and, under a limit, their number. Places without gaps
    take a job while the plan is built if there is no limit."""
    ranked = ranked_files(files, options)
    if options.max_results is None and not gapless:
        return ranked.withColumn("place", F.monotonically_increasing_id() + 1)  # sorted over many tasks
    if options.max_results is None:
        placed = numbered(ranked, "place", ranking.sort_keys(options.sort_by))
        return placed.withColumn("place", F.col("place") + 1)
    # at most max_results short rows
    order = Window.orderBy(*ranking.sort_keys(options.sort_by))
    return ranked.withColumns({"place": F.row_number().over(order).cast("long"), "n_files": F.count("*").over(Window.partitionBy())})


def _with_texts(files: DataFrame, winners: DataFrame, options: SearchOptions) -> DataFrame:
    """The winners with their prepared text. Their keys meet the raw files, so only winners are masked."""
    if options.search_path:
        root = options.search_path.rstrip("/") or "/"
        files = files.filter(predicates.under_root(F.col("path"), root))
    return files.select(*FILE_KEYS, "content").join(winners, FILE_KEYS).withColumn("content", prepared_text(options))


def _results(texts: DataFrame, options: SearchOptions, shown: int | None = None) -> DataFrame:
    """The files of ``_with_texts`` with their matches, in the order in which they come. Matches may be far larger than the texts, so texts are put in order before."""
    found = matching.file_matches(F.col("content"), pattern_of(options), options.snippet_length)
    found = found if shown is None else F.slice(found, F.lit(1), F.lit(shown))
    return texts.withColumn("matches", found).drop("content").withColumn("size_formatted", format_size(F.col("size")))


def search(files: DataFrame, options: SearchOptions) -> DataFrame:
    """One row per file with its ``matches`` array, in order, at most ``max_results`` files."""
    texts = _with_texts(files, _winners(files, options, gapless=False), options).orderBy("place")
    return _results(texts, options).drop("place", "n_files")


def _flat(files: DataFrame, winners: DataFrame, options: SearchOptions) -> DataFrame:
    rows = matching.find_matches(_with_texts(files, winners, options), pattern_of(options), options.snippet_length)
    ordered = rows.orderBy("place", "line_no", "match_ord")
    return ordered if options.max_results is None else ordered.limit(options.max_results)


def flat_matches(files: DataFrame, options: SearchOptions) -> DataFrame:
    """Match rows in file order, cut at ``max_results`` matches."""
    return _flat(files, _winners(files, options, gapless=False), options).drop("place", "n_files")


def _summary(winners: DataFrame) -> DataFrame:
    return winners.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_matches"), F.lit(0)).alias("n_matches"))


def result_summary(files: DataFrame, options: SearchOptions) -> DataFrame:
    """Number of files after the limit, and their matches."""
    return _summary(ranked_files(files, options))


def search_request(files: DataFrame, request: dict, roots: list[str] | None = None) -> DataFrame:
    """Serve a camelCase request: checks the path against the allow-list, then renders."""
    options = SearchOptions.from_request(request)
    allow = predicates.resolve_roots(roots or [])
    if options.search_path:
        base = allow[0] if allow else "/"
        resolved = predicates.resolve_roots([options.search_path], base)[0]
        if allow and not any(resolved == r or resolved.startswith(r.rstrip("/") + "/") for r in allow):
            raise PermissionError(f"{resolved} is outside the allowed directories")
        options = SearchOptions.from_request({**request, "searchPath": resolved, "path": None})
    return render_search(predicates.under_roots(files, allow), options)


def render_search(files: DataFrame, options: SearchOptions) -> DataFrame:
    """Text output as ``(block, ord, line)`` rows, in order: block 0 is the header, then one block
    per file (or per match in a flat list). ``json`` gives one document per file instead."""
    if options.output_format == "json":
        return result_json(search(files, options), pretty=True)
    winners = _winners(files, options)
    body = (_grouped_lines if options.group_by_file else _flat_lines)(files, winners, options)
    # The wording of the header and of the lines below.
    none = F.array(F.lit(f"No matches found for pattern: {options.pattern}"))

    def header(n_files: Column) -> Column:
        found = F.array(
            F.lit(f'# Search Results for: "{options.pattern}"'), F.format_string("Found %d file(s) with matches", n_files), F.lit("")
        )
        return F.when(F.coalesce(n_files, F.lit(0)) == 0, none).otherwise(found)

    first = F.lit(0).cast("long")
    block = lambda place, lines: F.struct(place.alias("block"), lines.alias("lines"))
    if options.max_results is None:
        head = _summary(winners).select(first.alias("block"), header(F.col("n_files")).alias("lines"))
        blocks = head.unionByName(body.select("block", "lines"))
    else:
        # the header goes with the first block, or alone, so that winners are looked for once
        seed = files.sparkSession.range(1).withColumnRenamed("id", "seed")
        led = seed.join(body, F.col("seed") == F.least("block", F.lit(0)), "left")
        own, top = block(F.col("block"), F.col("lines")), block(first, header(F.col("n_files")))
        pieces = F.when(F.col("block").isNull(), F.array(top)).when(F.col("block") == 1, F.array(top, own)).otherwise(F.array(own))
        blocks = led.select(F.inline(pieces))
    return blocks.select("block", F.posexplode("lines").alias("ord", "line")).orderBy("block", "ord")


def render_json_array(files: DataFrame, options: SearchOptions) -> DataFrame:
    """The results as the lines ``(block, line)`` of one pretty JSON array, a block for each file; ``[]`` without any."""
    winners = _winners(files, options)
    document = json_document(pretty=True).alias("document")
    if options.max_results is None:
        # the number of files is known once they are placed
        n_files = winners.count()
        if not n_files:
            return files.sparkSession.createDataFrame([(0, "[]")], "block long, line string")
        texts = in_order(_with_texts(files, winners, options), winners, n_files, "place", "size")
        documents = _results(texts, options).select(F.col("place").alias("block"), F.lit(n_files).alias("n_files"), document)
        return documents.select("block", _array_line().alias("line"))
    documents = _results(_with_texts(files, winners, options), options).select(F.col("place").alias("block"), "n_files", document)
    seed = files.sparkSession.range(1).withColumnRenamed("id", "seed")
    led = seed.join(documents, F.col("seed") == F.least("block", F.lit(0)), "left")
    return led.select(F.coalesce("block", F.lit(0)).alias("block"), F.coalesce(_array_line(), F.lit("[]")).alias("line")).orderBy("block")


def _array_line() -> Column:
    return F.concat(
        F.when(F.col("block") == 1, "[ ").otherwise(""), "document", F.when(F.col("block") == F.col("n_files"), " ]").otherwise(",")
    )


def _grouped_lines(files: DataFrame, winners: DataFrame, options: SearchOptions) -> DataFrame:
    results = _results(_with_texts(files, winners, options), options, SHOWN_PER_FILE)
    lines = F.flatten(
        F.array(
            F.array(
                F.concat(F.lit("## "), "rel_path"),
                F.concat(F.lit("Size: "), "size_formatted", F.lit(" | Modified: "),
                         F.coalesce(iso_utc("mtime"), F.lit(""))),
                F.format_string("Matches: %d", F.col("n_matches")),
                F.lit(""),
            ),
            F.transform(
                "matches",
                lambda m: F.concat(F.lit("Line "), m["line_no"].cast("string"), F.lit(": "), m["snippet"]),
            ),
            F.when(
                F.col("n_matches") > SHOWN_PER_FILE,
                F.array(F.format_string("... and %d more matches", F.col("n_matches") - SHOWN_PER_FILE)),
            ).otherwise(F.array().cast("array<string>")),
            F.array(F.lit("")),
        )
    )
    return results.select(F.col("place").alias("block"), lines.alias("lines"), *_counted(results))


def _flat_lines(files: DataFrame, winners: DataFrame, options: SearchOptions) -> DataFrame:
    rows = _flat(files, winners, options)
    if options.max_results is None:
        rows = numbered(rows, "_at", ["place", "line_no", "match_ord"])
        n = F.col("_at") + 1
    else:
        # at most max_results short rows
        n = F.row_number().over(Window.orderBy("place", "line_no", "match_ord")).cast("long")
    listed = rows.select(
        n.alias("block"),
        *_counted(rows),
        F.concat("rel_path", F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), "snippet").alias("line"),
    )
    cut = F.array(F.lit(""), F.lit(f"... search truncated at {options.max_results} results"))
    lines = F.when(
        F.lit(options.max_results is not None) & (F.col("block") == F.lit(options.max_results)), F.array_insert(cut, 1, F.col("line"))
    ).otherwise(F.array("line"))
    return listed.select("block", lines.alias("lines"), *_counted(listed))


def _counted(df: DataFrame) -> list[str]:
    return [c for c in ("n_files",) if c in df.columns]
