import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.filter_audit import audit_filters, judge_documents
from lodestone.llm.term_matrix import count_bytes, document_term_matrix, row_sums

from .conftest import LONG


def order_key(value):
    return (value is None, value)


def brute(rows, labels):
    """Every order applied document by document; rows are (id, text, part)."""
    least = {}
    for i, t, _ in rows:
        t = t or ""
        least[t] = min(least.get(t, i), i, key=order_key)
    documents = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if order_key(i) != order_key(least[t]):
            fails.add("E")
        own = [x for x in labels if x[0] == i and i is not None]
        documents.append((part or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {d[0] for d in documents}:
        own = [d for d in documents if d[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            there = own
            for step, name in enumerate(order, 1):
                gone = [d for d in there if name in d[1]]
                rest = [d for d in there if name not in d[1]]
                earlier = [d for d in own if name in d[1] and d not in there]
                redundant = sum(name in d[1] and bool(d[1] & set(order[: step - 1])) for d in own)
                assert redundant >= len(earlier) > -1
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(rest), len(gone), redundant, sum(d[1] == {name} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)
                ]
                there = rest
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture
def mixed(awkward):
    more = [(20 + i, (f"w{i % 5} " * 3 + "X" * (i % 3) + " #" * (i % 2)) * (1 + 60 * (i % 4 == 0)), ["p", "", None][i % 3]) for i in range(40)]
    rows = awkward.select("doc_id", "text", F.col("source").alias("source"))
    return rows.unionByName(rows.sparkSession.createDataFrame(more, "doc_id long, text string, source string")).selectExpr(
        "*", "1 key", "2 part", "3 node", "4 n_words", "5 failed", "6 n", "7 shard", "'x' word", "8 flags"
    )


def test_against_brute_force(spark, mixed):
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (21, 1, 1), (24, 0, 0), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 good", "2 part")
    got = {(r.part, r.filter_order, r.step): [r[n] for n in NAMES] for r in audit_filters(mixed, table).collect()}
    rows = [(r.doc_id, r.text, r.source) for r in mixed.collect()]
    assert got == brute(rows, labels)
    assert len(got) == 600 * len({k[0] for k in got})


def test_without_labels_or_documents(spark, mixed):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(mixed, labels).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)
    assert audit_filters(mixed.filter("false"), labels).count() == 0


def test_copies_by_smaller_id(spark):
    rows = [(3, "a"), (1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (4, None), (5, ""), (6, "A")]
    judged = judge_documents(spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string"))
    got = sorted(((r.key, r.failed >= 16) for r in judged.collect()), key=str)
    assert got == sorted([(3, True), (1, False), (1, False), (None, True), (None, False), (None, False), (4, False), (5, True), (6, False)], key=str)


@pytest.mark.parametrize("bits, shard_bytes", [(62, 1 << 24), (62, 300), (2, 300)])
def test_matrix(spark, bits, shard_bytes):
    """The matrix holds each document's words once, with their counts, under the dictionary's ids, whatever the shards' size, and also if hashes are shared."""
    texts = [(i, " ".join(f"w{(i * j) % 11}" for j in range(i))) for i in range(40)] + [(90, LONG), (91, None), (92, "a A a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    size = {"size": count_bytes(np.ones(256, bool))}
    dictionary, matrix = document_term_matrix(docs, {"key": F.col("doc_id")}, measures=size, shard_bytes=shard_bytes, hash_bits=bits)
    assert (matrix.count() > 4) == (shard_bytes < 1_000)
    words = {r.id: bytes(r.word).decode() for r in dictionary.collect()}
    assert len(set(words.values())) == len(words) == dictionary.count()
    got = {}
    for shard in matrix.collect():
        at = 0
        for key, size, total in zip(shard.key, shard.sizes, shard["size"], strict=True):
            got[key] = {words[shard.terms[c]]: n for c, n in zip(shard.columns[at : at + size], shard.counts[at : at + size], strict=True)}
            assert total == len((dict(texts)[key] or "").encode())
            at += size
        assert at == len(shard.columns) == len(shard.counts)
    assert got == {i: dict(Counter((t or "").split())) for i, t in texts}
    sums = {r.key: (r.n_words, r.n_distinct) for r in row_sums(matrix, ["key"]).collect()}
    assert sums == {i: (sum(own.values()), len(own)) for i, own in got.items()}
