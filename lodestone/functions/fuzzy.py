"""Edit distance and the "did you mean" score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space

# Fixed value: the largest bonus a shared prefix can earn.
PREFIX_BONUS = 3


def name_key(c: Column) -> Column:
    return F.lower(trim_space(c))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(name_key(a), name_key(b))


def suggest_score(query_key: Column, candidate_key: Column) -> Column:
    """Lower is better. Both sides are already ``name_key`` values."""
    prefix = F.when(
        candidate_key.startswith(query_key), F.least(F.lit(PREFIX_BONUS), F.length(query_key))
    ).otherwise(0)
    contains = F.when(candidate_key.contains(query_key), 1).otherwise(0)
    return F.levenshtein(query_key, candidate_key) - prefix - contains
