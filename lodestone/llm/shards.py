"""Sharding by weighted rendezvous hashing, with gapless positions inside each shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.materialize import materialize

#: Sub-buckets of a shard in which positions are counted; their counts are what is summed up.
BUCKETS = 256


def rendezvous_score(key: Column, shard: int, weight: float) -> Column:
    """A shard's draw for a key: the largest draw wins. ``-weight / ln(u)`` with u uniform in (0, 1) gives
    each shard a share in proportion to its weight, whatever other shards there are."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return F.lit(-float(weight)) / F.log(uniform)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard with the largest draw; of equal draws the higher number. A null key draws like
    any other value. Adding a shard at the end changes the answer only to that shard."""
    draws = [F.struct(rendezvous_score(key, i, w).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_max(F.array(*draws)).getField("shard") if draws else F.lit(None).cast("int")


def assign_shards(
    docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0
) -> DataFrame:
    """Rows ``(<key>, size, text_crc32, law, shard, slot, grown_shard)``, one for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 16 and ``text_crc32`` its checksum; a null text has size 16 and a
    null checksum, an empty one size 16 and checksum 0. ``shard`` depends on the key and the weights alone, so equal
    keys, nulls among them, share a shard, and ``grown_shard`` is the shard if one more is added. ``slot`` numbers a
    shard's rows from 0 without gaps; rows that are equal in all of these get neighbouring numbers in any order. An
    empty table gives no rows; other columns are not looked at.

    Positions need no task that holds a shard: a shard's rows are counted in ``BUCKETS`` parts by a hash, equal rows
    are folded into one with a count first, and only the parts' counts (shards x BUCKETS rows at most, which is
    the bound of the broadcast) are summed over a whole shard.
    """
    k = F.col(key)
    body = F.col(text)
    fresh = rendezvous_score(k, len(weights), grown_weight)
    draws = [F.struct(rendezvous_score(k, i, w).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    drawn = docs.select(
        k.alias("key"),
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.array_max(F.array(*draws)).alias("best"),
        fresh.alias("fresh"),
    )
    rows = drawn.select(
        "key",
        "size",
        "text_crc32",
        F.col("best.shard").alias("shard"),
        F.when(F.col("fresh") >= F.col("best.draw"), F.lit(len(weights))).otherwise(F.col("best.shard")).alias("grown_shard"),
        F.pmod(F.xxhash64("key", "text_crc32", F.lit("slot")), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    rows = materialize(rows, "shards")
    per_bucket = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = per_bucket.select(
        F.col("shard").alias("in_shard"),
        F.col("bucket").alias("in_bucket"),
        (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"),
    )
    folded = rows.groupBy("shard", "bucket", "key", "size", "text_crc32", "grown_shard").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", "size", "text_crc32")
    placed = folded.withColumn("upto", F.sum("n").over(within)).join(
        F.broadcast(before), (F.col("shard") == F.col("in_shard")) & (F.col("bucket") == F.col("in_bucket"))
    )
    last = F.col("before") + F.col("upto") - 1
    return placed.select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(last - F.col("n") + 1, last)).alias("slot"),
        "grown_shard",
    )
