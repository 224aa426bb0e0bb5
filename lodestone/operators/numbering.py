"""Gapless numbers for the rows of a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..materialize import materialize

#: ``monotonically_increasing_id`` has the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def numbered(rows: DataFrame, column: str, order: list[Column | str] | None = None) -> DataFrame:
    """``rows`` with a gapless number from 0 in ``column``, by ``order`` if one is given.

    Two passes and no window: rows are written once with their partition and place (sorted by ranges of ``order``, so that partitions follow one another),
    then the partitions' counts become offsets. Only these counts, one for each partition, pass the driver and are broadcast. Runs jobs while the plan is built.
    """
    placed = (rows.orderBy(*order) if order else rows).withColumn(column, F.monotonically_increasing_id())
    held = materialize(placed, "numbered")
    partition = F.shiftright(F.col(column), _PLACE_BITS)
    counts = held.groupBy(partition.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, before = [], 0
    for row in sorted(counts, key=lambda r: r["p"]):
        offsets.append((row["p"], before))
        before += row["n"]
    starts = rows.sparkSession.createDataFrame(offsets, "__p long, __before long")
    place = F.col(column).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        held.join(F.broadcast(starts), partition == F.col("__p"))
        .withColumn(column, place + F.col("__before"))
        .drop("__p", "__before")
    )
