"""Deal rows to tasks by the bytes that they stand for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..materialize import materialize
from ..ship import ship_package

_PLACE_BITS = 33
#: Bytes of the rows that a task sorts, what a row counts beside its size, and the ranges of places whose sizes pass the driver.
SORTED_BYTES, ROW_BYTES, RANGES = 64 << 20, 256, 4096


def packed(rows: DataFrame, size: str, target: int) -> DataFrame:
    """``rows`` in partitions whose ``size`` values (null: none) sum up to at most ``target``, but for rows that are larger alone, which get one each.

    Tasks fill bins with their own rows one after another, which are written to the shared folder; the number of bins of each
    partition, which is all that passes the driver, makes their numbers gapless, and each number is a partition. Runs jobs while the plan is built.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << _PLACE_BITS, 0
        empty = True
        for batch in batches:
            bins = np.empty(batch.num_rows, np.int64)
            for i, n in enumerate(batch.column(size).to_pylist()):
                n = max(n or 0, 0)
                if not empty and held + n > target:
                    number, held = number + 1, 0
                bins[i], held, empty = number, held + n, False
            yield batch.append_column("__bin", pa.array(bins))

    ship_package(rows.sparkSession)
    filled = materialize(rows.mapInArrow(fill, f"{kinds}, __bin bigint"), "packed")
    partition = F.shiftright("__bin", _PLACE_BITS)
    counts = filled.groupBy(partition.alias("p")).agg((F.max("__bin") - F.min("__bin") + 1).alias("n")).collect()  # one row a partition
    offsets, total = [], 0
    for row in sorted(counts, key=lambda r: r["p"]):
        offsets.append((row["p"], total))
        total += row["n"]
    if not total:
        return rows
    starts = rows.sparkSession.createDataFrame(offsets, "__p long, __before long")
    place = F.col("__bin").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + F.col("__before")
    dealt = filled.join(F.broadcast(starts), partition == F.col("__p")).withColumn("__bin", place.cast("int"))
    return dealt.repartitionById(total, "__bin").drop("__bin", "__p", "__before")


def in_order(rows: DataFrame, places: DataFrame, n: int, place: str, size: str) -> DataFrame:
    """``rows`` sorted by ``place`` over all partitions, each of which has rows of ``SORTED_BYTES`` at most, or one range of places. ``places`` has the
    numbers from 1 to ``n``, each with a ``size`` in bytes. Large rows often come together, so ranges of equal counts wouldn't do. Runs a job while the plan is built."""
    if not n:
        return rows
    cell = F.call_function("div", (F.col(place) - 1) * F.lit(RANGES), F.lit(n))
    weight = F.sum(F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)) + F.lit(ROW_BYTES))
    weights = {r["cell"]: r["bytes"] for r in places.groupBy(cell.alias("cell")).agg(weight.alias("bytes")).collect()}  # RANGES rows at most
    target = min(SORTED_BYTES, 1 + sum(weights.values()) // (2 * rows.sparkSession.sparkContext.defaultParallelism))
    parts, held, part = [], 0, 0
    for i in range(RANGES):
        if held and held + weights.get(i, 0) > target:
            part, held = part + 1, 0
        held += weights.get(i, 0)
        parts.append(part)
    part_of = F.split(F.lit(",".join(map(str, parts))), ",").cast("array<int>")
    dealt = rows.repartitionById(part + 1, F.coalesce(F.get(part_of, cell.cast("int")), F.lit(0)))
    return dealt.sortWithinPartitions(place)
