import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import class_lm as C
from lodestone.llm.queries import op4_class_bigrams

from .conftest import space_words

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*space_words(text), None]


def base_scores(documents):
    counts = Counter()
    for i, text in documents:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    for i, text in documents:
        own = tokens(text)
        yield i, len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)


def check(found, documents):
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=repr)
    for g, w in zip(got, sorted(base_scores(documents), key=repr), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9)


@pytest.mark.parametrize("head", [C.HEAD_WORDS, 60])
def test_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(C.head_threshold, "__defaults__", (head,))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = op4_class_bigrams(spark, SF).collect()
    check(found, docs)
    held_out = [r for r in found if r.held_out]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in found)


def test_scores_are_probabilities(spark):
    """The words of the training texts and one unknown word of each class share a probability of one after any class."""
    docs = spark.createDataFrame([(i, "a b a c. d9 long-long-word é") for i in range(1, 9)], "doc_id long, text string")
    model, rest = C.train_model(docs)
    assert rest.count() == 0
    total = 0.0
    for k in range(model.clustered):
        c = model.classes[k]
        total += 10 ** (model.moves[0, c] + math.log10(model.counts[k] + C.WORD_PRIOR) - model.totals[c])
    end = model.classes[model.clustered]
    total += 10 ** (model.moves[0, end] + math.log10(model.ends + C.WORD_PRIOR) - model.totals[end])
    for c in range(len(model.totals)):
        total += 10 ** (model.moves[0, c] + math.log10(C.WORD_PRIOR) - model.totals[c])
    assert total == pytest.approx(1, abs=1e-9)


def test_exchange_finds_classes():
    """Words that alternate between two kinds fall into two classes."""
    rng = np.random.default_rng(0)
    kinds = np.array([0, 1] * 10)
    transitions = rng.integers(0, 3, (20, 20)) + 50 * (kinds[:, None] != kinds[None, :])
    found = C.exchange(transitions, 20, classes=2)
    assert len({(a, b) for a, b in zip(kinds.tolist(), found.tolist(), strict=True)}) == 2


def test_awkward_rows(spark, awkward, none_at_all):
    check(C.score_corpus(awkward).collect(), [(r.doc_id, r.text) for r in awkward.collect()])
    assert C.score_corpus(none_at_all).collect() == []
    nobody = awkward.filter("doc_id is null")
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in C.score_corpus(nobody).collect())


def test_words_beyond_the_core_have_learned_classes(spark, monkeypatch):
    """Words of two kinds alternate and have one shape: with few of them in the core the others fall into the classes of their kinds."""
    monkeypatch.setattr(C, "CLUSTERED", 12)
    monkeypatch.setattr(C.exchange, "__defaults__", (2, C.EXCHANGE_ROUNDS))
    monkeypatch.setattr(C, "CLASSES", 2)
    rng = np.random.default_rng(3)
    names = [chr(97 + i) * 2 + "x" for i in range(24)]
    texts = [" ".join(names[2 * rng.integers(0, 12) + k % 2] for k in range(40)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate([*texts, "once"], 1)), "doc_id long, text string")
    model, rest = C.train_model(docs)
    of = dict(zip(model.words, model.head_classes.tolist(), strict=True))
    assert model.clustered == 12 and len(of) == 25 and rest.count() == 0
    assert len({(i % 2, of[n.encode()]) for i, n in enumerate(names)}) == 2
    assert of[b"once"] == model.classes[model.clustered + 1 + C.shape_of(b"once")] >= 2


def test_joined_words_count_as_held_ones(spark, monkeypatch):
    """The same scores whether tasks hold the further words or these are joined."""
    monkeypatch.setattr(C, "CLUSTERED", 40)
    scores = []
    for head in (C.HEAD_WORDS, 60):
        monkeypatch.setattr(C.head_threshold, "__defaults__", (head,))
        scores.append({r.doc_id: (r.n_known, r.base_score, r.score) for r in op4_class_bigrams(spark, SF).collect()})
    assert scores[0].keys() == scores[1].keys()
    for i, one in scores[0].items():
        assert one == pytest.approx(scores[1][i], rel=1e-9)


def test_contexts_have_one_row_a_word(spark):
    """A task hands on the contexts of a word together: not a row for each."""
    docs = spark.createDataFrame([(1, "a new b new a a b a b"), (2, "b new a")], "doc_id long, text string").coalesce(1)
    symbols = C.Symbols([b"a", b"b"])
    classes = np.array([0, 1, 2, *[3] * C.SHAPES])
    rows = [(bytes(r.word), r.codes, r.times) for r in C.count_contexts(docs, symbols, classes).collect()]
    assert rows == [(b"new", [0, 1, 4, 5], [1, 2, 2, 1])]


def test_rows_of_a_word_are_summed_up(spark, monkeypatch):
    """Over batches and blocks of words too: each context has its share of the sums, and words below the least count are left out."""
    monkeypatch.setattr(C, "TRIED_WORDS", 2)
    monkeypatch.setattr(C, "LEARNED_FROM", 3)
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        # of the two classes, 0 stands after 1 and 1 after 0
        pairs = np.array([[1, 50, 1], [50, 1, 1], [1, 1, 1]])
        like = {0: [1, 4], 1: [0, 3]}  # the contexts that words of each class have
        words = [(f"w{i}".encode(), like[i % 2], [1, 1]) for i in range(7) for _ in range(3)] + [(b"rare", like[0], [2, 2])]
        contexts = spark.createDataFrame(words, "word binary, codes array<int>, times array<long>")
        found = {bytes(r.word): r.cls for r in C.learn_classes(contexts, pairs, 2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", own)
    assert found == {f"w{i}".encode(): i % 2 for i in range(7)}


def test_shapes_of_many_words():
    words = [b"a", b"abcdefghi9", "\u00e9t\u00e9".encode(), b"x.", b"-", "\u00e9a".encode(), b"0123456789,", b"z" * 10, b"\xff"]
    found = C.shapes_of(C.pa.array([b"cut", *words], C.pa.binary()).slice(1))
    assert found.tolist() == [C.shape_of(w) for w in words] and len(C.shapes_of(C.pa.array([], C.pa.binary()))) == 0
    numbers = C.Numbers([b"k", C.END])
    assert numbers.of([b"k", b"q9", C.END, b"q9", b"r."]).tolist() == [0, 2, 1, 2, 3]
    assert numbers.shapes_of_others().tolist() == [C.shape_of(b"q9"), C.shape_of(b"r.")]
    numbers.forget_others()
    assert numbers.of([b"r.", b"k"]).tolist() == [2, 0] and numbers.others().to_pylist() == [b"r."]
