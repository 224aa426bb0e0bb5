import hashlib
import re

import pytest

from lodestone.llm import decontaminate as D
from lodestone.llm.queries import op2_wu_manber

from .conftest import LONG, PASSAGE, lowered

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute(documents, items, window=10):
    """For each text the number of words, the hit words and the items."""
    patterns = {}
    for number, text in items:
        own = words(text)
        for k in range(max(1, len(own) - window + 1)) if own else []:
            patterns.setdefault(tuple(own[k : k + window]), set()).add(str(number))
    out = []
    for text in documents:
        own, hit, found = words(text), set(), set()
        for size in {len(p) for p in patterns}:
            for k in range(len(own) - size + 1):
                if owners := patterns.get(tuple(own[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= owners
        out.append((len(own), hit, found))
    return out


def hits(spans):
    return {i for a, b in zip(spans[::2], spans[1::2], strict=True) for i in range(a, b)}


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_against_brute_force(spark, awkward, block_bytes):
    items = [(1, PASSAGE), (2, "the dog for a while"), (3, None), (4, ""), (5, "sat"), (None, "cat"), (1, PASSAGE), (6, LONG[:5000]), (7, "on the")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_contamination(awkward, benchmark, block_bytes=block_bytes).select("text", "n_words", "hit_spans", "hit_items").collect()
    assert len(found) == awkward.count()
    want = brute([r.text for r in found], [i for i in items if i[0] is not None and i[1]])
    for r, (n, hit, items_hit) in zip(found, want, strict=True):
        assert (r.n_words, hits(r.hit_spans), r.hit_items) == (n, hit, sorted(items_hit))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {
        d.doc_id: (n, len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        for d, (n, hit, found) in zip(docs, brute([d.text for d in docs], items), strict=True)
    }
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op2_wu_manber(spark, SF).collect()}
    assert got == want and any(v[4] for v in got.values())


def test_empty_tables_and_columns(spark, awkward, none_at_all):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    found = D.find_contamination(awkward, benchmark)
    assert set(found.columns) == {*awkward.columns, "hit_spans", "hit_items"}
    assert all(r.hit_spans == [] and r.hit_items == [] for r in found.collect())
    assert D.find_contamination(none_at_all, benchmark).collect() == []


def test_search_reports_overlaps_and_repeats():
    search = D.WindowSearch([(1, b"a b"), (2, b"b a b"), (3, b"a")])
    spans, found = search.find(D.words_of(b"A b a B a"))
    assert sorted(spans) == [(0, 1), (0, 2), (1, 4), (2, 3), (2, 4), (4, 5)] and found == {1, 2, 3}
