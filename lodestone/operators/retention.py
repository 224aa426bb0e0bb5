"""Bounded logs: keep the newest entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

# Fixed value: entries a log keeps.
LOG_ENTRIES = 1_000
#: Parts of the order's range that rows are counted in, and those that orders of other kinds are dealt to.
STEPS, BUCKETS = 4_096, 64


def latest_n(log: DataFrame, order: list[str], n: int = LOG_ENTRIES) -> DataFrame:
    """The ``n`` newest rows, by ``order`` descending.

    If the first column of the order is a number or a time, its values are counted in ``STEPS`` steps of their range; a filter
    then leaves the newest steps that hold ``n`` rows, so that besides these at most the rest of one step is sorted. Both counts
    read that column alone; they run while the plan is built. For other orders tasks keep the newest of each of ``BUCKETS`` parts."""
    newest = [F.desc(c) for c in order]
    kind = log.schema[order[0]].dataType
    if isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        return _newest_steps(log, order[0], kind, n).orderBy(*newest).limit(n)
    part = Window.partitionBy(F.pmod(F.xxhash64(*order), F.lit(BUCKETS))).orderBy(*newest)
    candidates = log.withColumn("_turn", F.row_number().over(part)).filter(F.col("_turn") <= n).drop("_turn")
    return candidates.orderBy(*newest).limit(n)


def _newest_steps(log: DataFrame, column: str, kind: DataType, n: int) -> DataFrame:
    """The rows in the newest steps of a column that hold ``n`` rows together; all rows if it has fewer values."""
    value = F.col(column)
    if isinstance(kind, DateType):
        value = F.unix_date(value)
    elif not isinstance(kind, NumericType):
        value = F.unix_micros(value.cast("timestamp"))
    value = value.cast("double")
    finite = (value > float("-inf")) & (value < float("inf"))  # the others are in the first or the last step
    least, most = log.agg(F.min(F.when(finite, value)), F.max(F.when(finite, value))).first()
    if least is None or least == most:
        return log
    step = F.when(F.isnan(value), F.lit(float(STEPS))).when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.floor((value - least) / (most - least) * STEPS).cast("double"), F.lit(float(STEPS)))))
    held = 0
    for row in sorted(log.groupBy(step.alias("step")).count().filter("step IS NOT NULL").collect(), key=lambda r: -r["step"]):  # STEPS + 1 rows at most
        held += row["count"]
        if held >= n:
            return log.filter(step >= row["step"])
    return log


def latest_per_key(log: DataFrame, keys: list[str], order: list[str], n: int = LOG_ENTRIES) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return (
        log.withColumn("_turn", F.row_number().over(newest)).filter(F.col("_turn") <= n).drop("_turn")
    )
