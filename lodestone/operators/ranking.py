"""Result order and limits. Every order ends in ``path`` so that ties are settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTS = ("relevance", "file", "lineNumber", "modified", "size")


def locale_order(column: str) -> Column:
    return F.collate(F.col(column), "UNICODE")


def sort_keys(sort_by: str = "relevance") -> list[Column]:
    keys = {
        "relevance": [F.desc("n_matches")],
        "file": [locale_order("rel_path"), F.col("rel_path")],
        "lineNumber": [F.col("first_line")],
        "modified": [F.desc("mtime")],
        "size": [F.desc("size")],
    }
    if sort_by not in keys:
        raise ValueError(f"sort_by is one of {', '.join(SORTS)}")
    return [*keys[sort_by], F.col("path"), F.col("corpus_id")]


def top_files(counted: DataFrame, sort_by: str = "relevance", limit: int | None = 100) -> DataFrame:
    """The first files in order, or all of them. Rows are metadata only, so each task keeps ``limit`` short rows."""
    ordered = counted.orderBy(*sort_keys(sort_by))
    return ordered if limit is None else ordered.limit(limit)
