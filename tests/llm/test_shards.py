import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import shards as S
from lodestone.llm.queries import op8_rendezvous_shards

SF = "/root/testdata/sf0.001"


def check(found, documents, n=40):
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < n and r.grown_shard in (r.shard, n) and r.law == "key"
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    want = Counter((i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t in documents)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(op8_rendezvous_shards(spark, SF).collect(), docs)


def test_awkward_rows(spark, awkward, none_at_all):
    found = S.assign_shards(awkward, [1.0] * 40).collect()
    check(found, [(r.doc_id, r.text) for r in awkward.collect()])
    assert len({r.shard for r in found if r.doc_id is None}) == 1
    assert S.assign_shards(none_at_all, [1.0] * 40).collect() == []


def test_growth_moves_rows_only_into_the_new_shard(spark):
    ids = spark.range(4000).withColumn("text", F.lit("t")).withColumnRenamed("id", "doc_id")
    small = {r.doc_id: r for r in S.assign_shards(ids, [1.0] * 7).collect()}
    large = {r.doc_id: r.shard for r in S.assign_shards(ids, [1.0] * 8).collect()}
    assert all(large[i] == r.grown_shard for i, r in small.items())
    assert 0.08 < sum(s == 7 for s in large.values()) / 4000 < 0.17


def test_weights_are_shares(spark):
    ids = spark.range(6000).withColumn("text", F.lit(None).cast("string")).withColumnRenamed("id", "doc_id")
    counts = Counter(r.shard for r in S.assign_shards(ids, [1.0, 2.0, 3.0]).collect())
    assert all(abs(counts[i] / 6000 - (i + 1) / 6) < 0.03 for i in range(3))


def test_no_python(spark):
    plan = op8_rendezvous_shards(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shards_against_the_draws(spark):
    """Each row's shard is the one with the largest draw, worked out again in plain Python from the hashes."""
    weights = [1.0, 2.0, 0.5, 1.0]
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    hashes = rows.select("doc_id", F.array(*[F.xxhash64("doc_id", F.lit(i)) for i in range(5)]).alias("h")).collect()

    def winner(h, own):
        draws = [(-w / math.log(((x % 2**64 >> 11) + 0.5) / 2.0**53), i) for i, (x, w) in enumerate(zip(h, own))]
        return max(draws)[1]

    got = {r.doc_id: (r.shard, r.grown_shard) for r in S.assign_shards(rows, weights).collect()}
    assert got == {r.doc_id: (winner(r.h, weights), winner(r.h, [*weights, 1.0])) for r in hashes}
