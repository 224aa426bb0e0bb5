"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import fuzzy, paths
from lodestone.functions import text as T
from lodestone.functions.patterns import compile_pattern
from lodestone.operators import edits, graph, matching, outdated, predicates, retention, suggestions
from lodestone.operators.declarations import extract_all, extract_specifiers
from lodestone.operators.project_roots import find_project_roots
from lodestone.plans import search as S
from lodestone.plans.answers import missing_paths
from lodestone.plans.explore import explore
from lodestone.plans.options import SearchOptions
from lodestone.plans.outdated import render_outdated
from lodestone.sources.alias_config import read_alias_config
from lodestone.sources.dependency_reports import parse_outdated
from lodestone.sources.sinks import iso_utc, result_json

from . import corpora as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# -- pattern search -----------------------------------------------------------------------------


@query
def search_literal_matches(spark, sf_dir):
    rows = matching.find_matches(C.documents(spark, sf_dir), compile_pattern("the"))
    return rows.select(
        "path", long("line_no").alias("line_no"), long("match_ord").alias("match_ord"),
        long("match_start").alias("match_start"), long("match_end").alias("match_end"), "snippet",
    )


@query
def search_count_per_file(spark, sf_dir):
    top = S.ranked_files(C.documents(spark, sf_dir), SearchOptions(pattern="the"))
    return top.select("path", long("n_matches").alias("n_matches"))


@query
def search_case_sensitive(spark, sf_dir):
    counted = matching.match_counts(C.documents(spark, sf_dir), compile_pattern("The", case_sensitive=True))
    return counted.select("path", long("n_matches").alias("n_matches"))


@query
def search_word_boundary(spark, sf_dir):
    counted = matching.match_counts(C.documents(spark, sf_dir), compile_pattern("de", word_boundary=True))
    return counted.select("path", long("n_matches").alias("n_matches"))


@query
def search_regex(spark, sf_dir):
    pattern = compile_pattern(r"[a-z]+tion\b", regex_mode=True)
    rows = matching.find_matches(C.turns(spark, sf_dir), pattern, with_line=True)
    found = F.substr("line", F.col("match_start") + 1, F.col("match_end") - F.col("match_start"))
    return rows.select(
        "path", long("line_no").alias("line_no"), long("match_ord").alias("match_ord"), found.alias("found")
    )


@query
def search_regex_counts(spark, sf_dir):
    pattern = compile_pattern(r"^\w+|[.!?]$", regex_mode=True)
    counted = matching.match_counts(C.turns(spark, sf_dir), pattern)
    return counted.select("path", long("n_matches").alias("n_matches"))


def _sorted(spark, sf_dir, sort_by: str, *columns: str) -> DataFrame:
    options = SearchOptions(pattern="ing", sort_by=sort_by, max_results=50)
    results = S.search(C.documents(spark, sf_dir), options)
    place = F.row_number().over(Window.orderBy(*S.ranking.sort_keys(sort_by)))  # at most 50 rows
    return results.withColumn("place", long(place)).select(
        "place", "path", long("n_matches").alias("n_matches"), *columns
    )


@query
def search_sort_relevance(spark, sf_dir):
    return _sorted(spark, sf_dir, "relevance")


@query
def search_sort_file(spark, sf_dir):
    return _sorted(spark, sf_dir, "file")


@query
def search_sort_line(spark, sf_dir):
    return _sorted(spark, sf_dir, "lineNumber", "first_line")


@query
def search_sort_size(spark, sf_dir):
    return _sorted(spark, sf_dir, "size", "size")


@query
def search_sort_modified(spark, sf_dir):
    return _sorted(spark, sf_dir, "modified")


@query
def search_flat_topk(spark, sf_dir):
    options = SearchOptions(pattern="ing", sort_by="file", group_by_file=False, max_results=200)
    return S.flat_matches(C.documents(spark, sf_dir), options).select(
        "path", long("line_no").alias("line_no"), long("match_ord").alias("match_ord"), "snippet"
    )


@query
def search_head_per_file(spark, sf_dir):
    found = matching.find_matches(C.documents(spark, sf_dir), compile_pattern("ing"))
    heads = matching.head_per_file(matching.group_matches(found))
    return heads.select(
        "path", long("overflow").alias("overflow"), F.posexplode("matches").alias("at", "m")
    ).select("path", "overflow", long(F.col("at") + 1).alias("place"), long("m.line_no").alias("line_no"),
             long("m.match_start").alias("match_start"))


@query
def search_summary(spark, sf_dir):
    options = SearchOptions(pattern="ing", extensions=[".py", ".js"], max_results=40)
    return S.result_summary(C.documents(spark, sf_dir), options)


@query
def search_filtered(spark, sf_dir):
    options = SearchOptions(
        pattern="ing", extensions=[".py", ".JS", ".html"], exclude_extensions=["js"], exclude_patterns=["src1?", "zz"],
        min_size=200, max_size=20_000, modified_after="2024-01-02", modified_before="2034-01-01T00:00:00Z",
        max_depth=2, exclude_strings=True, exclude_comments=True, max_results=None,
    )
    return S.ranked_files(C.documents(spark, sf_dir), options).select("path", "size")


@query
def search_all_files(spark, sf_dir):
    """No limit on files."""
    found = S.ranked_files(C.documents(spark, sf_dir), SearchOptions(pattern="ing", max_results=None))
    return found.select("path", long("n_matches").alias("n_matches"))


@query
def search_below_path(spark, sf_dir):
    """From a directory that lies below an excluded one; depth and relative paths count from there."""
    docs = C.documents(spark, sf_dir)
    placed = C.corpus_from_table(docs, F.concat(F.lit("/r/build/"), F.col("path")), "content", root=F.lit("/r"))
    options = SearchOptions(pattern="the", search_path="/r/build/src0", max_depth=1, max_results=None)
    found = S.search(placed, options)
    return found.select("path", "rel_path", long("depth").alias("depth"), long("n_matches").alias("n_matches"))


@query
def search_text_report(spark, sf_dir):
    options = SearchOptions(pattern="ing", max_results=30)
    return S.render_search(C.documents(spark, sf_dir), options).select(
        long("block").alias("block"), long("ord").alias("ord"), "line"
    )


@query
def search_flat_report(spark, sf_dir):
    options = SearchOptions(pattern="ing", sort_by="file", group_by_file=False, max_results=150)
    return S.render_search(C.documents(spark, sf_dir), options).select(
        long("block").alias("block"), long("ord").alias("ord"), "line"
    )


@query
def search_json(spark, sf_dir):
    options = SearchOptions(pattern="ing", sort_by="size", max_results=20)
    docs = result_json(S.search(C.documents(spark, sf_dir), options))
    shape = "filePath string, fileSizeFormatted string, lastModified string, matches array<struct<lineNumber: long, snippet: string>>"
    parsed = docs.select(F.from_json("json", shape).alias("j"))
    return parsed.select(
        F.col("j.filePath").alias("path"), F.col("j.fileSizeFormatted").alias("size_text"),
        F.col("j.lastModified").alias("modified"), F.posexplode("j.matches").alias("at", "m"),
    ).select("path", "size_text", "modified", long("at").alias("at"), F.col("m.lineNumber").alias("line_no"), "m.snippet")


@query
def search_json_array(spark, sf_dir):
    """One JSON array of all files, without a limit: its lines, put together again."""
    lines = S.render_json_array(C.documents(spark, sf_dir), SearchOptions(pattern="ing", sort_by="size", max_results=None))
    item = F.regexp_replace("line", r"^\[ |(?: \]|,)\z", "")
    shape = "filePath string, matches array<struct<lineNumber: long>>"
    parsed = lines.select(long("block").alias("block"), F.from_json(item, shape).alias("j"), F.col("line").endswith(" ]").alias("is_last"))
    return parsed.select("block", F.col("j.filePath").alias("path"), long(F.size("j.matches")).alias("n_matches"), long("is_last").alias("is_last"))


@query
def search_lines_all(spark, sf_dir):
    """Blocks of a flat text without a limit are numbered without gaps."""
    options = SearchOptions(pattern="ing", sort_by="size", group_by_file=False, max_results=None)
    lines = S.render_search(C.documents(spark, sf_dir), options).filter("block > 0")
    return lines.select(long("block").alias("block"), F.substring_index("line", ":", 2).alias("place"))


@query
def mask_comments_html(spark, sf_dir):
    masked = T.mask_comments(F.col("content"), F.col("ext"))
    return C.web_pages(spark, sf_dir).select(
        "path", long(F.length(masked)).alias("n_chars"), F.md5(masked).alias("digest")
    )


@query
def mask_strings(spark, sf_dir):
    masked = T.mask_strings(F.col("content"))
    return C.web_pages(spark, sf_dir).select(
        "path", long(F.length(masked)).alias("n_chars"), F.md5(masked).alias("digest")
    )


@query
def mask_comments_code(spark, sf_dir):
    """Line numbers after masking, over generated scripts and Python."""
    scripts = C.item_sources(spark, sf_dir, ".ts", C.script_body())
    pythons = C.item_sources(spark, sf_dir, ".py", C.python_body())
    files = scripts.unionByName(pythons).withColumn(
        "content", T.mask_comments(F.col("content"), F.col("ext"))
    )
    hits = matching.find_matches(files, compile_pattern("import", word_boundary=True))
    return hits.groupBy("path").agg(
        F.count("*").alias("n"), F.sum("line_no").alias("line_sum"), F.sum("match_start").alias("start_sum")
    )


@query
def binary_files(spark, sf_dir):
    """A NUL inside or just outside the sniffed head of every other turn."""
    body = F.encode(F.col("content"), "utf-8")
    pad = F.encode(F.repeat(F.lit("-"), 1023), "utf-8")
    nul = F.encode(F.lit("\x00"), "utf-8")
    size = F.octet_length("content")
    sniffed = C.turns(spark, sf_dir).select(
        "path", T.is_binary(F.concat(body, nul)).alias("tail_nul"), T.is_binary(F.concat(pad, nul, body)).alias("head_nul"),
        long(size).alias("size"),
    )
    return sniffed.select("path", "size", F.col("tail_nul").cast("int").alias("tail_nul"), F.col("head_nul").cast("int").alias("head_nul"))


# -- corpus facts and predicates ------------------------------------------------------------------


@query
def file_facts(spark, sf_dir):
    """Every derived file column."""
    files = C.documents(spark, sf_dir)
    return files.select(
        "path", "parent_dir", "basename", "ext", long("depth").alias("depth"), "size",
        F.col("is_empty").cast("int").alias("is_empty"), iso_utc("mtime").alias("modified"),
        F.coalesce(paths.file_class(F.col("ext")), F.lit("none")).alias("class"),
    )


@query
def file_predicates(spark, sf_dir):
    files = C.documents(spark, sf_dir)
    files = predicates.prune_default_dirs(files)
    files = predicates.exclude_names(files, ["src1*", "/no/such", "99"])
    files = predicates.ext_not_in(predicates.ext_in(files, [".py", ".HTML", "js"]), [".min.js"])
    files = predicates.size_between(files, 100, 50_000)
    files = predicates.modified_between(files, "2024-01-03", "not a date")
    files = predicates.drop_hidden(predicates.max_depth(files, 2))
    return predicates.under_roots(files, []).select("path", "size")


@query
def prune_and_allow(spark, sf_dir):
    """Excluded directories and allow-lists over the manifest tree."""
    files = predicates.under_roots(C.manifest_tree(spark, sf_dir), ["/r/ECONOMY/", " /r/PROMO", "/r/STANDARD/s1"])
    kept = predicates.prune_default_dirs(files, applies_to="dirs")
    return kept.groupBy("corpus_id", "basename").agg(F.count("*").alias("n"), F.sum("depth").alias("depth_sum"))


@query
def roots_table(spark, sf_dir):
    """An allow-list from a table, with roots below roots and repeated ones."""
    part = C.table(spark, sf_dir, "part")
    listed = F.array(C.text(" /r/", F.col("p_type"), "/"), C.text("/r/", F.col("p_type"), "/s", F.col("p_size")), F.lit(""))
    roots = part.filter(F.col("p_type").isin("ECONOMY", "PROMO")).select(F.explode(listed).alias("root")).unionByName(
        part.filter("p_type = 'STANDARD' AND p_size = 1").select(C.text("/r/STANDARD/s1").alias("root"))
    )
    kept = predicates.under_root_table(C.manifest_tree(spark, sf_dir), roots)
    return kept.groupBy("corpus_id", "basename").agg(F.count("*").alias("n"), F.sum("depth").alias("depth_sum"))


@query
def format_size(spark, sf_dir):
    orders = C.table(spark, sf_dir, "orders")
    size = F.floor(F.col("o_totalprice") * F.pow(F.lit(10), F.col("o_orderkey") % 7 - 3)).cast("long")
    return orders.select("o_orderkey", size.alias("size")).select(
        "o_orderkey", "size", paths.format_size(F.col("size")).alias("shown")
    )


@query
def normalize_path(spark, sf_dir):
    items = C.distinct_items(spark, sf_dir)
    order, part, supp, line = C.item_columns()
    given = C.text("a/./o", order, "//x/../l", line, "/../../s", supp, "/p", part, ".ts/.")
    folded = items.select(
        paths.normalize_path(given, "/base/dir/..").alias("path"), paths.normalize_path(given).alias("folded")
    ).distinct()
    path = F.col("path")
    return folded.select(
        "path", paths.relative_path(path, "/base").alias("rel"), paths.dirname(path).alias("parent"), "folded"
    )


@query
def project_roots(spark, sf_dir):
    roots = find_project_roots(C.manifest_tree(spark, sf_dir))
    return roots.select("corpus_id", long("rank").alias("rank"), "dir", long("depth").alias("depth"))


@query
def alias_config(spark, sf_dir):
    rules = read_alias_config(C.configs(spark, sf_dir))
    return rules.select(
        "corpus_id", long("key_ord").alias("key_ord"), "key", "prefix", "suffix",
        F.col("has_star").cast("int").alias("has_star"), long("target_ord").alias("target_ord"), "target", "base_dir",
    )


# -- declarations ---------------------------------------------------------------------------------


def _extracted(files: DataFrame, language: str) -> DataFrame:
    return extract_all(files, [language]).select("path", "section", "rendered")


@query
def extract_python(spark, sf_dir):
    return _extracted(C.item_sources(spark, sf_dir, ".py", C.python_body()), "python")


@query
def extract_rust(spark, sf_dir):
    return _extracted(C.item_sources(spark, sf_dir, ".rs", C.rust_body()), "rust")


@query
def extract_go(spark, sf_dir):
    return _extracted(C.item_sources(spark, sf_dir, ".go", C.go_body()), "go")


@query
def extract_java(spark, sf_dir):
    return _extracted(C.item_sources(spark, sf_dir, ".java", C.java_body()), "java")


@query
def extract_kotlin(spark, sf_dir):
    return _extracted(C.item_sources(spark, sf_dir, ".kt", C.kotlin_body()), "kotlin")


@query
def extract_csharp(spark, sf_dir):
    return _extracted(C.item_sources(spark, sf_dir, ".cs", C.csharp_body()), "csharp")


@query
def extract_script(spark, sf_dir):
    return _extracted(C.item_sources(spark, sf_dir, ".ts", C.script_body()), "script")


@query
def extract_lexical(spark, sf_dir):
    return _extracted(C.item_sources(spark, sf_dir, ".tsx", C.lexical_body()), "script")


@query
def extract_declarators(spark, sf_dir):
    return _extracted(C.item_sources(spark, sf_dir, ".ts", C.declarators_body()), "script")


@query
def extract_counts(spark, sf_dir):
    """All languages in one scan."""
    bodies = {".py": C.python_body(), ".rs": C.rust_body(), ".go": C.go_body(), ".java": C.java_body(),
              ".kts": C.kotlin_body(), ".cs": C.csharp_body(), ".jsx": C.script_body()}
    items = C.distinct_items(spark, sf_dir)
    made = items.select(
        F.explode(F.array(*[
            F.struct(C.text("items/i", C.item_name(), ext).alias("path"), body.alias("body")) for ext, body in bodies.items()
        ])).alias("f")
    ).select("f.*")
    decls = extract_all(C.corpus_from_table(made, "path", "body"))
    return decls.groupBy("lang", "section", F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


@query
def extract_specifier_list(spark, sf_dir):
    specs = extract_specifiers(C.item_sources(spark, sf_dir, ".ts", C.script_body()))
    return specs.groupBy("specifier").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"))


# -- dependency graph -----------------------------------------------------------------------------


def _edges(spark, sf_dir, with_rules: bool = True) -> DataFrame:
    files = C.shop(spark, sf_dir)
    specs = extract_specifiers(files, ["script"])
    return graph.build_edges(files, specs, read_alias_config(files) if with_rules else None)


@query
def edges(spark, sf_dir):
    return _edges(spark, sf_dir, with_rules=False).select("corpus_id", "src", "dst")


@query
def alias_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("corpus_id", "src", "dst")


@query
def in_degree_top(spark, sf_dir):
    top = graph.top_degree(graph.in_degree(_edges(spark, sf_dir)))
    return top.select("corpus_id", long("rank").alias("rank"), "path", "n")


@query
def out_degree_top(spark, sf_dir):
    files = C.shop(spark, sf_dir)
    top = graph.top_degree(graph.out_degree(_edges(spark, sf_dir), files))
    return top.select("corpus_id", long("rank").alias("rank"), "path", "n")


@query
def edge_count(spark, sf_dir):
    return graph.edge_count(_edges(spark, sf_dir))


@query
def local_imports(spark, sf_dir):
    listed = graph.local_imports(_edges(spark, sf_dir))
    return listed.select("corpus_id", "path", F.array_join("local_imports", ",").alias("imports"))


@query
def import_candidates(spark, sf_dir):
    """Candidate paths of relative bases, tried one by one against the part files."""
    stems = graph.files_by_stem(C.shop(spark, sf_dir))
    bases = stems.withColumn("base", F.explode(F.array_distinct(
        F.transform("paths", lambda path: F.regexp_replace(path, r"(/index)?\.[a-z]+$", ""))
    )))
    tried = graph.expand_candidates(bases, "base").filter(F.array_contains("paths", F.col("candidate")))
    first = tried.groupBy("corpus_id", "stem", "base").agg(F.min("cand_ord").alias("cand_ord"))
    return first.groupBy("corpus_id", "cand_ord").agg(F.count("*").alias("n")).select(
        "corpus_id", long("cand_ord").alias("cand_ord"), "n"
    )


@query
def explore_overview(spark, sf_dir):
    files = C.shop(spark, sf_dir)
    rows = explore(files)

    def joined(column: str) -> Column:
        return F.coalesce(F.array_join(column, " | "), F.lit("")).alias(column)

    return rows.select(
        "corpus_id", "rel_path", "size", F.col("is_empty").cast("int").alias("is_empty"),
        F.coalesce("file_type", F.lit("")).alias("file_type"), joined("imports"), joined("exports"), joined("local_imports"),
    )


@query
def explore_sub_dir(spark, sf_dir):
    """The overview of a directory inside each project, with an alias config of its own."""
    files = C.shop(spark, sf_dir)
    inner = C.corpus_from_table(
        files, F.regexp_replace("path", "^/shop/", "/shop/build/"), "content", corpus_id="corpus_id", root=F.lit("/shop")
    )
    rows = explore(inner, sub_dir="build")
    local = F.coalesce(F.array_join("local_imports", " | "), F.lit("")).alias("local_imports")
    return rows.select("corpus_id", "root", "rel_path", "size", local)


# -- suggestions ----------------------------------------------------------------------------------


@query
def suggest_topk(spark, sf_dir):
    asked = ["customer#00000001", "Custmer#000000123", " ustomer#00000007 ", "supplier", "#0000004"]
    got = suggestions.suggest_names(C.table(spark, sf_dir, "customer"), "c_name", asked)
    return got.select("query", long("rank").alias("rank"), "candidate", long("score").alias("score"))


@query
def suggest_table(spark, sf_dir):
    """Queries from a table: market segments against customer names and segments."""
    customer = C.table(spark, sf_dir, "customer")
    asked = customer.select(F.concat(F.lower("c_mktsegment"), F.lit("s")).alias("wanted"))
    candidates = customer.select(F.explode(F.array("c_name", "c_mktsegment")).alias("name"))
    got = suggestions.suggest_names(candidates, "name", asked, k=3, query="wanted")
    return got.select("query", long("rank").alias("rank"), "candidate", long("score").alias("score"))


@query
def edit_distances(spark, sf_dir):
    """Edit distance and score between the words of each part's name and its type."""
    parts = C.table(spark, sf_dir, "part")
    name, kind = F.col("p_name"), F.substring_index("p_name", " ", 1)
    return parts.select("p_name", "p_type").distinct().select(
        "p_name", "p_type", long(fuzzy.edit_distance(name, F.col("p_type"))).alias("distance"),
        long(fuzzy.suggest_score(fuzzy.name_key(kind), fuzzy.name_key(name))).alias("score"),
    )


@query
def suggest_paths(spark, sf_dir):
    asked = C.customer_requests(spark, sf_dir, "fil_", ".jsn")
    got = suggestions.suggest_paths(asked, C.customer_tree(spark, sf_dir), k=3)
    return got.select("request_id", long("rank").alias("rank"), "suggestion", long("score").alias("score"))


@query
def suggest_project(spark, sf_dir):
    asked = C.customer_requests(spark, sf_dir, "d")
    got = suggestions.suggest_project(asked, C.customer_tree(spark, sf_dir))
    return got.select("request_id", long("rank").alias("rank"), "suggestion")


def _answers(spark, sf_dir, asker: str) -> DataFrame:
    asked = C.customer_requests(spark, sf_dir, "fil_", ".jsn") if asker in ("rename", "delete") else C.customer_requests(spark, sf_dir, "d")
    return missing_paths(C.customer_tree(spark, sf_dir), asked, asker).select("request_id", "message")


@query
def search_missing(spark, sf_dir):
    return _answers(spark, sf_dir, "search")


@query
def explore_missing(spark, sf_dir):
    return _answers(spark, sf_dir, "explore")


@query
def outdated_missing(spark, sf_dir):
    return _answers(spark, sf_dir, "outdated")


@query
def rename_missing(spark, sf_dir):
    return _answers(spark, sf_dir, "rename")


@query
def delete_missing(spark, sf_dir):
    return _answers(spark, sf_dir, "delete")


# -- freshness reports ----------------------------------------------------------------------------


def _runs(spark, sf_dir) -> DataFrame:
    return parse_outdated(C.freshness_runs(spark, sf_dir))


@query
def outdated_rows(spark, sf_dir):
    return outdated.explode_outdated(_runs(spark, sf_dir))


@query
def outdated_production(spark, sf_dir):
    return outdated.production_only(outdated.explode_outdated(_runs(spark, sf_dir))).select("project", "package", "type")


@query
def outdated_by_type(spark, sf_dir):
    return outdated.outdated_by_type(outdated.explode_outdated(_runs(spark, sf_dir)))


@query
def outdated_summary(spark, sf_dir):
    return outdated.outdated_summary(_runs(spark, sf_dir)).select(
        "project", long("n_checked").alias("n_checked"), long("n_outdated").alias("n_outdated"),
        F.col("has_outdated").cast("int").alias("has_outdated"),
    )


@query
def report_status(spark, sf_dir):
    return outdated.report_status(_runs(spark, sf_dir)).select("project", "status")


@query
def outdated_detailed(spark, sf_dir):
    return render_outdated(_runs(spark, sf_dir)).select("project", long("ord").alias("ord"), "line")


@query
def outdated_text(spark, sf_dir):
    return render_outdated(_runs(spark, sf_dir), "summary").select("project", long("ord").alias("ord"), "line")


# -- edits and retention --------------------------------------------------------------------------


def rename_requests(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    part = C.table(spark, sf_dir, "part")
    stem = C.text("/", F.col("p_brand"), "/", F.col("p_type"))
    single = part.filter(key % 3 != 2).select(
        key.alias("request_id"),
        F.when(key % 3 == 0, C.text(stem, "/p", key, ".ts")).otherwise(C.text(stem, "/x", key, ".ts")).alias("old_path"),
        F.when(key % 2 == 0, C.text(stem, "/q", key, ".ts")).otherwise(C.text("/", F.col("p_brand"), "/moved/p", key, ".ts")).alias("new_path"),
    )
    whole = part.filter(F.col("p_type") == "PROMO").select("p_brand", "p_type").distinct().select(
        (F.lit(1_000_000_000_000) + F.regexp_extract("p_brand", r"\d+", 0).cast("long")).alias("request_id"),
        stem.alias("old_path"), C.text("/", F.col("p_brand"), "/OLD").alias("new_path"),
    )
    return single.unionByName(whole).withColumn("corpus_id", F.lit(""))


@query
def rename_paths(spark, sf_dir):
    after, _ = edits.rename_paths(C.part_tree(spark, sf_dir), rename_requests(spark, sf_dir))
    return after.select("path", "rel_path", "size")


@query
def rename_status(spark, sf_dir):
    status = edits.rename_status(C.part_tree(spark, sf_dir), rename_requests(spark, sf_dir), ["/Brand#1", "/Brand#2", "/Brand#3"])
    return status.select("request_id", "old_path", "new_path", "status")


def chain_requests(spark, sf_dir) -> DataFrame:
    """Renames that build on each other: chains, ways back, sources that are gone, directories renamed twice after files in them were moved."""
    key = F.col("p_partkey")
    part = C.table(spark, sf_dir, "part")
    stem = C.text("/", F.col("p_brand"), "/", F.col("p_type"))
    own = C.text(stem, "/p", key, ".ts")

    def request(step, old, new):
        return F.struct((key * 10 + step).alias("request_id"), old.alias("old_path"), new.alias("new_path"))

    chain = F.array(
        request(1, own, C.text(stem, "/t", key, ".ts")), request(2, C.text(stem, "/t", key, ".ts"), C.text("/", F.col("p_brand"), "/chain/c", key, ".ts"))
    )
    back = F.array(
        request(1, own, C.text(stem, "/w", key, ".ts")), request(2, own, C.text(stem, "/v", key, ".ts")), request(3, C.text(stem, "/w", key, ".ts"), own)
    )
    single = part.select(F.inline(F.when(key % 4 == 0, chain).when(key % 4 == 1, back).when(key % 4 == 2, F.array(request(1, own, own))).otherwise(F.array().cast("array<struct<request_id:bigint,old_path:string,new_path:string>>"))))
    brand = C.text("/", F.col("p_brand"))
    number = F.lit(1_000_000_000_000) + F.regexp_extract("p_brand", r"\d+", 0).cast("long") * 10
    twice = F.array(
        F.struct(number.alias("request_id"), C.text(brand, "/PROMO").alias("old_path"), C.text(brand, "/OLD").alias("new_path")),
        F.struct((number + 1).alias("request_id"), C.text(brand, "/OLD").alias("old_path"), C.text(brand, "/NEW/deep").alias("new_path")),
    )
    whole = part.filter(F.col("p_type") == "PROMO").select("p_brand").distinct().select(F.inline(twice))
    return single.unionByName(whole).withColumn("corpus_id", F.lit(""))


@query
def rename_chain(spark, sf_dir):
    after, _ = edits.rename_in_order(C.part_tree(spark, sf_dir, "p_name"), chain_requests(spark, sf_dir))
    return after.select("path", F.md5("content").alias("digest"))


@query
def rename_chain_status(spark, sf_dir):
    _, status = edits.rename_in_order(C.part_tree(spark, sf_dir), chain_requests(spark, sf_dir))
    return status.select("request_id", "old_path", "new_path", "status")


@query
def rename_contents(spark, sf_dir):
    after, _ = edits.rename_paths(C.part_tree(spark, sf_dir, "p_name"), rename_requests(spark, sf_dir))
    return after.select("path", F.md5("content").alias("digest"))


def delete_requests(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    part = C.table(spark, sf_dir, "part")
    stem = C.text("/", F.col("p_brand"), "/", F.col("p_type"))
    no = F.lit(False)
    single = part.filter(key % 4 != 3).select(
        key.alias("request_id"),
        F.when(key % 4 == 0, C.text(stem, "/p", key, ".ts")).otherwise(C.text(stem, "/gone", key)).alias("path"), no.alias("recursive"), no.alias("force"),
    )
    whole = part.select("p_brand", "p_type").distinct().select(
        (F.lit(1_000_000_000_000) + F.regexp_extract("p_brand", r"\d+", 0).cast("long") * 100 + F.length("p_type")).alias("request_id"),
        stem.alias("path"), (F.col("p_type") == "PROMO").alias("recursive"), F.lit(True).alias("force"),
    )
    return single.unionByName(whole).withColumn("corpus_id", F.lit(""))


@query
def delete_paths(spark, sf_dir):
    after, _ = edits.delete_paths(C.part_tree(spark, sf_dir), delete_requests(spark, sf_dir))
    return after.select("path", "size")


@query
def delete_contents(spark, sf_dir):
    after, _ = edits.delete_paths(C.part_tree(spark, sf_dir, "p_name"), delete_requests(spark, sf_dir))
    return after.select("path", F.md5("content").alias("digest"))


@query
def delete_status(spark, sf_dir):
    status = edits.delete_status(C.part_tree(spark, sf_dir), delete_requests(spark, sf_dir), ["/Brand#1", "/Brand#2"])
    return status.select("request_id", "path", "status")


@query
def latest_events(spark, sf_dir):
    return retention.latest_n(C.table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query
def latest_events_per_user(spark, sf_dir):
    kept = retention.latest_per_key(C.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 20)
    return kept.select("event_id", "user_id", "event_type", "value")
