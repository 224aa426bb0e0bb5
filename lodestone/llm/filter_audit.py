"""What each of five filters removes in every order in which they can be applied."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.term_matrix import count_bytes, document_term_matrix, row_sums
from lodestone.materialize import materialize

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"

_BYTES = np.arange(256)
MEASURES = {
    "capitals": count_bytes((_BYTES >= 65) & (_BYTES <= 90)),
    "symbols": count_bytes(np.isin(_BYTES, list(SYMBOLS))),
    "code_points": count_bytes((_BYTES & 0xC0) != 0x80),
}


def judge_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows ``(key, part, node, n_words, n_distinct, failed)``, one for each row of ``docs``: its id, its part, a key of its text, its words, its distinct words, and
    the filters that it fails as bits (1 for A, 2 for B and so on), but E only where a smaller id has the same text.

    A and B come from the row sums and the numbers of pairs of the document-term matrix, C and D from the text; E from the least id of each text.
    A null text counts as empty, a null part as the empty string; a null id as larger than all others. Rows of one id with one text are no copies of each other.
    """
    carried = {
        "key": F.col(doc_id),
        "part": F.coalesce(F.col(part).cast("string"), F.lit("")),
        "node": F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)),
    }
    _, matrix = document_term_matrix(docs, carried, text, MEASURES)
    rows = row_sums(matrix, [*carried, *MEASURES])
    fails = [
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT_PERCENT * F.col("n_words"),
        100 * F.col("capitals") > MOST_CAPITALS_PERCENT * F.col("code_points"),
        F.col("symbols") > 0,
    ]
    flags = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    rows = materialize(rows.withColumn("flags", flags).drop(*MEASURES), "judged")
    first = rows.groupBy("node").agg(F.min("key").alias("least")).withColumnRenamed("node", "of")
    # joined by text and id: copies of a text, however many, spread over all tasks
    found = rows.join(first, (F.col("node") == F.col("of")) & F.col("key").eqNullSafe(F.col("least")), "left")
    copy = F.when(F.col("of").isNull(), 16).otherwise(0)
    return found.select("key", "part", "node", "n_words", "n_distinct", (F.col("flags") + copy).cast("int").alias("failed"))


def count_failures(judged: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows ``(part, failed, n, good, toxic)``: documents of a part that fail just these filters, and how many of them are labelled good and toxic."""
    own = labels.groupBy(F.col(doc_id).alias("of")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    total = lambda name: F.sum(F.coalesce(F.col(name), F.lit(0))).cast("long").alias(name)
    return (
        judged.select("key", "part", "failed")
        .join(own, F.col("key") == F.col("of"), "left")
        .groupBy("part", "failed")
        .agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))
    )


def _places() -> Column:
    """Every order and step: the order, the step, the bit of its filter and the bits of those before."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            rows.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")))
            before |= bit
    return F.array(*rows)


def audit_orders(failures: DataFrame) -> DataFrame:
    """Rows ``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` for each part, order of filters and step, from
    ``failures`` (see ``count_failures``). A part has at most 32 rows there, so each part is one small array, and its 600 places are worked out inside the row.

    In one of ``120 / k`` orders a filter is the first of the ``k`` that a document fails; so ``shapley`` needs no pass over the orders.
    """
    parts = failures.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("counts"))
    rows = parts.select("part", "counts", F.explode(_places()).alias("at"))
    bit, before = F.col("at.bit"), F.col("at.before")
    has = lambda c: c["failed"].bitwiseAND(bit) != 0
    earlier = lambda c: c["failed"].bitwiseAND(before) != 0

    def total(keep, value=lambda c: c["n"]) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(keep(c), value(c)).otherwise(F.lit(0)))

    removed = lambda c: has(c) & ~earlier(c)
    orders = F.lit(120)
    return rows.select(
        "part",
        "at.filter_order",
        "at.step",
        total(lambda c: c["failed"].bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total(removed).alias("removed"),
        total(lambda c: has(c) & earlier(c)).alias("redundant"),
        total(lambda c: c["failed"] == bit).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(has, lambda c: c["n"] * (orders / F.bit_count(c["failed"])).cast("long")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of all rows of ``docs`` (see ``judge_documents`` and ``audit_orders``).

    The filters: A, fewer than 200 words; B, fewer distinct words than half of all; C, more than 2 capitals A-Z in 100 characters; D, any of ``#$%&*|``; E, the text of
    a smaller id. ``labels(<doc_id>, quality, toxic)`` may hold several rows of an id: one that says 1 is enough; documents without a label, or with a null id, count
    as neither. An empty table of documents gives no rows; other columns are not looked at. Texts are read whole.
    """
    return audit_orders(count_failures(judge_documents(docs, doc_id, text, part), labels, doc_id))
