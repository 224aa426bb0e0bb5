import random

import numpy as np
import pytest

from lodestone.llm import near_dedup as N
from lodestone.llm.queries import op3_circulant_minhash

from .conftest import space_words

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = space_words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(documents, percent=85):
    """The size of each set and the smallest id that each one reaches."""
    sets = [(i, shingles(t)) for i, t in documents]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            inter = len(sets[a][1] & sets[b][1])
            if inter and 100 * inter >= percent * len(sets[a][1] | sets[b][1]):
                parent[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(find(k), []).append(i)
    least = {r: min((i for i in own if i is not None), default=None) for r, own in groups.items()}
    return [(i, len(s), least[find(k)] if s else i) for k, (i, s) in enumerate(sets)]


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def variants(n, changes, seed=1):
    """Copies of one text with some words changed, whose similarities lie on both sides of the limit."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.choice(changes)):
            own[rng.randrange(len(own))] = f"c{rng.randrange(30)}"
        out.append((1000 + i, " ".join(own)))
    return out


def test_sets_have_the_right_sizes():
    texts = ["", " ", "a", "A a", "a b c d", "a b c d e", "a b c d e f", "x y x y x y x y x y", "é É\x0ba"]
    sets = N.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    one, two, three = N.shingle_sets([b"a b", b"A\tB", b"ab"])
    assert one.tolist() == two.tolist() != three.tolist()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    s, t = N.circulant_signatures([np.concatenate([common, a]), np.concatenate([common, b])], 512)
    assert abs((s == t).mean() - 0.8) < 0.08


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = op3_circulant_minhash(spark, SF)
    assert rows(found) == sorted(brute(docs), key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_awkward_rows(spark, awkward, none_at_all):
    want = brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert rows(N.near_duplicates(awkward)) == sorted(want, key=repr)
    assert N.near_duplicates(none_at_all).collect() == []


@pytest.mark.parametrize("unit", [512, 8])
def test_group_of_variants(spark, monkeypatch, unit):
    monkeypatch.setattr(N, "UNIT_TEXTS", unit)
    documents = variants(90, [1, 2, 4, 6, 9]) + [(i, f"other text number {i} " * 3) for i in range(20)]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    assert rows(N.near_duplicates(docs)) == sorted(brute(documents), key=repr)


def test_one_document_of_each_group_stays(spark, awkward):
    kept = N.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = sorted({(r.doc_id, r.text) for r in awkward.collect()} - {(1, awkward.filter("doc_id = 1").first().text)}, key=repr)
    assert got == want


def test_one_survivor_with_null_and_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    documents = [(None, base), (None, base + " x"), (None, base + " y"), (7, other), (7, other + " x"), (8, other + " y"), (9, "apart from all"), (9, "apart from all")]
    kept = N.drop_near_duplicates(spark.createDataFrame(documents, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 7), (False, 9), (True, 0)]


def test_units_hold_a_repeated_row_once(spark):
    base = " ".join(f"w{i}" for i in range(40))
    texts = spark.range(20_000).selectExpr("1L AS doc_id", f"'{base}' AS text").unionByName(spark.createDataFrame([(2, base + " x")], "doc_id long, text string"))
    assert [(r.doc_id, r.text) for r in N.drop_near_duplicates(texts).collect()] == [(1, base)]
