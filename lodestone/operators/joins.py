"""Join helper for keys that one project or directory can dominate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: never collected for a broadcast. Spark's estimates see compressed files and not
    what ``explode`` and ``concat`` add, so they take tables of many hundred MB for small ones."""
    return df.hint("merge")


def salted_join(
    many: DataFrame, few: DataFrame, on: list[str], spread_by: list[str], how: str = "inner", grows: bool = True
) -> DataFrame:
    """Equi-join ``many`` with the much smaller ``few`` so that no key is one task: the rows of a
    key are spread over ``SALTS`` parts by a hash of ``spread_by``, and ``few`` is repeated in each.
    Exact for inner, left_semi and left joins. ``few`` is shuffled if it ``grows`` with the corpus, else Spark may broadcast it."""
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    repeated = few.withColumn("_part", parts)
    return many.withColumn("_part", salt).join(
        shuffled(repeated) if grows else repeated, [*on, "_part"], how
    ).drop("_part")
