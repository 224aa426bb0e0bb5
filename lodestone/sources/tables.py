"""A table as a corpus: any rows with a path and a text become files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

FILE_KEYS = ["corpus_id", "path"]
FILE_COLUMNS = [
    "corpus_id", "root", "path", "rel_path", "parent_dir", "basename", "ext", "depth",
    "size", "mtime", "is_empty",
]


def describe_files(df: DataFrame, *extra: str) -> DataFrame:
    """Add the derived file columns to ``(corpus_id, root, path, size, mtime)`` rows."""
    rel = paths.relative_path(F.col("path"), F.col("root"))
    return df.withColumn("rel_path", rel).select(
        "corpus_id",
        "root",
        "path",
        "rel_path",
        paths.dirname(F.col("path")).alias("parent_dir"),
        paths.basename(F.col("path")).alias("basename"),
        paths.path_ext(F.col("path")).alias("ext"),
        (F.length("rel_path") - F.length(F.replace("rel_path", F.lit("/"), F.lit("")))).alias("depth"),
        F.col("size").cast("long").alias("size"),
        F.col("mtime").cast("timestamp").alias("mtime"),
        (F.col("size") == 0).alias("is_empty"),
        *extra,
    )


def corpus_from_table(
    df: DataFrame,
    path: Column | str,
    content: Column | str,
    *,
    size: Column | str | None = None,
    mtime: Column | str | None = None,
    corpus_id: Column | str | None = None,
    root: Column | str | None = None,
) -> DataFrame:
    """``files`` rows with ``content``. Unused columns are pruned back to the scan, so a query on
    paths alone never reads the text. ``root`` defaults to the empty root of relative paths."""

    def col(value: Column | str) -> Column:
        return F.col(value) if isinstance(value, str) else value

    base = df.select(
        (F.lit("") if corpus_id is None else col(corpus_id).cast("string")).alias("corpus_id"),
        (F.lit("") if root is None else col(root)).alias("root"),
        col(path).alias("path"),
        (F.octet_length(col(content)) if size is None else col(size)).alias("size"),
        (F.lit(None).cast("timestamp") if mtime is None else col(mtime)).alias("mtime"),
        col(content).alias("content"),
    )
    return describe_files(base, "content")
