from pyspark.sql import functions as F

from lodestone.operators.numbering import numbered


def test_numbers_follow_the_order_without_gaps(spark):
    rows = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("v"), "id").repartition(7)
    got = numbered(rows, "at", [F.col("v").desc()]).orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(10_000))
    assert [r.v for r in got] == sorted((r.v for r in got), reverse=True)


def test_numbers_without_an_order_and_of_no_rows(spark):
    rows = spark.range(0, 1_000, 1, 5)
    assert sorted(r["at"] for r in numbered(rows, "at").collect()) == list(range(1_000))
    assert numbered(rows.filter("id < 0"), "at").collect() == []
