"""Directories that hold a package manifest, nearest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from .joins import shuffled
from .predicates import DEFAULT_EXCLUDED_DIRS

# The manifest's name and the search limits.
MANIFEST = "package.json"
MAX_DEPTH = 4
LIMIT = 5


def find_project_roots(
    files: DataFrame, manifest: str = MANIFEST, max_depth: int = MAX_DEPTH, limit: int = LIMIT
) -> DataFrame:
    """``(corpus_id, rank, dir, depth)``. Excluded and dot-directories are not entered, and nothing
    below a hit counts."""
    parts = F.split("rel_path", "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    start_name = F.substring_index("root", "/", -1)
    hits = files.filter(
        (F.col("basename") == manifest)
        & (F.col("depth") <= max_depth)
        & ~start_name.isin(DEFAULT_EXCLUDED_DIRS)
        & ~F.exists(dirs, lambda d: d.startswith(".") | d.isin(DEFAULT_EXCLUDED_DIRS))
    ).select("corpus_id", "root", F.col("parent_dir").alias("dir"), "depth")
    top = F.when(F.col("root") == "", F.lit(".")).otherwise(F.col("root"))
    above = hits.select(
        "corpus_id",
        "dir",
        F.explode(F.array_union(ancestors(F.col("dir")), F.array(top))).alias("above"),
    ).filter(F.col("above") != F.col("dir"))
    nested = above.join(
        shuffled(hits.select("corpus_id", F.col("dir").alias("above"))), ["corpus_id", "above"], "left_semi"
    ).select("corpus_id", "dir")
    order = Window.partitionBy("corpus_id").orderBy("depth", "dir")
    return (
        hits.select("corpus_id", "dir", "depth")
        .join(shuffled(nested), ["corpus_id", "dir"], "left_anti")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("corpus_id", "rank", "dir", "depth")
    )
