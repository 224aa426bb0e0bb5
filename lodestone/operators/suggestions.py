"""Fuzzy "did you mean" suggestions for names and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import name_key, suggest_score
from ..functions.paths import ancestors, basename, dirname
from .joins import salted_join, shuffled
from .project_roots import MAX_DEPTH, find_project_roots
from .ranking import locale_order

# How many suggestions are given for paths and for names.
PATH_LIMIT = 5
NAME_LIMIT = 3
# Queries that one pass over the candidates scores; more take more passes.
QUERY_BLOCK = 1_000


def _best(scored: DataFrame, keys: list[str], candidate: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("score", locale_order(candidate), candidate)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def suggest_names(
    candidates: DataFrame, column: str, queries: list[str] | DataFrame, k: int = PATH_LIMIT, query: str = "query"
) -> DataFrame:
    """``(query, rank, candidate, score)``: the closest distinct candidates to each distinct query.

    The queries are a list or a column ``query`` of a table, which is counted while the plan is built. They are the stated set that is
    compared with all candidates, in blocks of about ``QUERY_BLOCK`` (a table's are dealt by a hash): a candidate meets a block as
    one row, which scores the block's queries, and each task keeps ``k`` rows per query. Blank queries give nothing.
    """
    spark = candidates.sparkSession
    wanted = F.transform("queries", lambda q: F.struct(q.alias("query"), name_key(q).alias("wanted")))
    if isinstance(queries, DataFrame):
        asked = queries.select(F.col(query).alias("query")).filter(F.trim(F.col("query")) != "").distinct()
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        dealt = asked.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).agg(
            F.collect_list("query").alias("queries")
        )  # a block's queries are bounded by QUERY_BLOCK
    else:
        named = [q for q in dict.fromkeys(queries) if q and q.strip(" ")]
        blocks = max(1, -(-len(named) // QUERY_BLOCK))
        dealt = spark.createDataFrame([(b, named[b::blocks]) for b in range(blocks)], "block long, queries array<string>")
    dealt = dealt.select("block", wanted.alias("asked"))
    if not isinstance(queries, DataFrame):
        # nothing is known of a list's size, so that Spark would rather collect the candidates, to meet them in one task
        dealt = F.broadcast(dealt)
    # names weigh little and their scores much, which are sorted in each task: sized by bytes, a few tasks would hold all of them
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = (
        candidates.select(F.col(column).alias("candidate"))
        .filter(F.col("candidate") != "")
        .repartition(parts, "candidate")
        .distinct()
        .withColumn("key", name_key(F.col("candidate")))
    )
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    met = distinct.withColumn("block", every_block).join(dealt, "block")
    scored = met.select("candidate", "key", F.inline("asked")).withColumn("score", suggest_score(F.col("wanted"), F.col("key")))
    return _best(scored, ["query"], "candidate", k).select("query", "rank", "candidate", "score")


def _directories_above(path: Column) -> Column:
    """Ancestors of a path, with ``.`` for the top of a relative one."""
    relative = F.when(path.startswith("/"), F.array().cast("array<string>")).otherwise(
        F.array(F.lit("."))
    )
    return F.concat(relative, ancestors(path))


def siblings(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct entries of the directories that ``requests`` (``corpus_id``, ``parent_dir``) name:
    ``(corpus_id, parent_dir, name, is_dir)``. Directories are implied by the files below them."""
    path = F.col("path")
    wanted = requests.select("corpus_id", "parent_dir").distinct()
    bare = F.when(path.startswith("/"), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))
    placed = files.select("corpus_id", "path", F.explode(F.concat(bare, _directories_above(path))).alias("parent_dir"))
    below = F.when(F.col("parent_dir") == ".", path).otherwise(
        F.substr(path, F.length(F.rtrim("parent_dir", F.lit("/"))) + 2)
    )
    return (
        salted_join(placed, wanted, ["corpus_id", "parent_dir"], ["path"])
        .select(
            "corpus_id",
            "parent_dir",
            F.substring_index(below, "/", 1).alias("name"),
            below.contains("/").alias("is_dir"),
        )
        .distinct()
    )


def suggest_paths(
    requests: DataFrame, files: DataFrame, k: int = PATH_LIMIT, dirs_only: bool = False
) -> DataFrame:
    """``(corpus_id, request_id, rank, suggestion, score)`` for missing paths: the closest entries of
    the directory each path was expected in. ``requests`` has ``corpus_id``, ``request_id``, ``path``.

    A directory's entries are spread over tasks and ranked in two steps, so a flat directory that
    holds much of the corpus stays parallel; requests that ask for the same path are scored once.
    """
    asked = requests.select(
        "corpus_id",
        F.col("path").alias("wanted_path"),
        dirname(F.col("path")).alias("parent_dir"),
        name_key(basename(F.col("path"))).alias("wanted"),
    ).filter(F.col("wanted") != "").distinct()
    entries = siblings(asked, files)
    if dirs_only:
        entries = entries.filter("is_dir")
    scored = salted_join(entries, asked, ["corpus_id", "parent_dir"], ["name"]).withColumn(
        "score", suggest_score(F.col("wanted"), name_key(F.col("name")))
    )
    best = _best(scored, ["corpus_id", "wanted_path"], "name", k).select(
        "corpus_id",
        F.col("wanted_path").alias("path"),
        "rank",
        F.when(F.col("parent_dir") == ".", F.col("name"))
        .otherwise(F.concat(F.rtrim("parent_dir", F.lit("/")), F.lit("/"), "name"))
        .alias("suggestion"),
        "score",
    )
    return best.join(shuffled(requests.select("corpus_id", "path", "request_id")), ["corpus_id", "path"]).select(
        "corpus_id", "request_id", "rank", "suggestion", "score"
    )


def suggest_project(requests: DataFrame, files: DataFrame, k: int = PATH_LIMIT) -> DataFrame:
    """Sibling directories first, then project roots below the path; ``k`` in all, repeats kept.

    Each path asked for is worked on once, however many requests name it. A manifest counts for the nearest directories above it
    only, as deep as roots are looked for.
    """
    asked = requests.select("corpus_id", "path").distinct()
    near = suggest_paths(asked.withColumn("request_id", F.col("path")), files, k, dirs_only=True).select(
        "corpus_id", F.col("request_id").alias("path"), F.lit(0).alias("origin"), "rank", "suggestion"
    )
    manifests = files.filter(F.col("basename") == "package.json")
    tops = asked.withColumnRenamed("path", "top")
    above = _directories_above(F.col("path"))
    nearest = F.slice(above, F.greatest(F.size(above) - MAX_DEPTH, F.lit(1)), F.lit(MAX_DEPTH + 1))
    below = salted_join(
        manifests.select("corpus_id", "path", "parent_dir", "basename", F.explode(nearest).alias("top")), tops, ["corpus_id", "top"], ["path"]
    )
    # each path asked for is a small corpus of its own
    rel = F.when(F.col("top") == ".", F.col("path")).otherwise(F.substr("path", F.length("top") + 2))
    rooted = below.select(
        F.to_json(F.struct("corpus_id", "top")).alias("corpus_id"),
        F.when(F.col("top") == ".", F.lit("")).otherwise(F.col("top")).alias("root"),
        "path",
        rel.alias("rel_path"),
        "parent_dir",
        "basename",
        (F.size(F.split(rel, "/")) - 1).alias("depth"),
    )
    roots = find_project_roots(rooted, limit=k).select(
        F.from_json("corpus_id", "corpus_id string, top string").alias("of"), "rank", "dir"
    )
    found = roots.select(
        F.coalesce("of.corpus_id", F.lit("")).alias("corpus_id"), F.col("of.top").alias("path"), F.lit(1).alias("origin"), "rank",
        F.col("dir").alias("suggestion"),
    )
    order = Window.partitionBy("corpus_id", "path").orderBy("origin", "rank")
    best = near.unionByName(found).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return best.join(shuffled(requests.select("corpus_id", "path", "request_id")), ["corpus_id", "path"]).select(
        "corpus_id", "request_id", F.col("place").alias("rank"), "suggestion"
    )
