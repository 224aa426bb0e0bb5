import numpy as np
import pytest

from lodestone.llm import language_id as L
from lodestone.llm.queries import op1_byte_network

SF = "/root/testdata/sf0.001"


def test_windows_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 509, 510, 2000):
        text = bytes(np.random.default_rng(n).integers(1, 255, n, dtype=np.uint8))
        windows, counts = L.cut_windows([text])
        assert counts[0] == len(windows)
        covered = b"".join(bytes(w[: L.STEP]) for w in windows[:-1]) + (bytes(windows[-1]) if n else b"")
        assert covered.rstrip(b"\0") == text


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = L.ByteNet.fresh(["a", "b", "c"])
    windows, answers, weight = rng.integers(1, 255, (5, L.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.ones(5, np.float32)

    def loss():
        return -np.log(net.probabilities(windows)[np.arange(5), answers]).mean()

    windows = L.folded(windows)
    for p, g in zip(net.parameters(), net.gradients(windows, answers, weight), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at].copy(), 1e-2
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.15, abs=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = op1_byte_network(spark, SF).join(docs, "doc_id").filter("held_out and lang is not null").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.9


def test_prediction_does_not_look_at_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = L.train(docs)
    plain = L.identify_languages(docs.select("doc_id", "text"), net).select("doc_id", "lang_pred", "score")
    other = L.identify_languages(docs.selectExpr("doc_id", "'zz' lang", "text"), net).select("doc_id", "lang_pred", "score")
    assert sorted(plain.collect()) == sorted(other.collect())


def test_awkward_rows(spark, awkward):
    net = L.train(spark.read.parquet(f"{SF}/documents.parquet"))
    found = L.identify_languages(awkward, net)
    assert found.columns[-2:] == ["lang_pred", "score"] and len(found.columns) == len(awkward.columns)
    rows = found.select("doc_id", "text", "lang_pred", "score").collect()
    assert len(rows) == awkward.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert 0 <= r.score <= 1 and (letters or r.score == 0)
    kept = L.identify_languages(awkward, net, min_score=0.0)
    assert kept.columns == awkward.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)


def test_nothing_to_learn(spark, awkward, none_at_all):
    assert L.train(none_at_all) is None
    assert {r.lang_pred for r in L.identify_languages(awkward, None).collect()} == {"und"}
    assert L.identify_languages(none_at_all, None).collect() == []
    assert L.train(awkward.selectExpr("doc_id", "text", "cast(null as string) lang")) is None


def test_every_language_is_learned_from(spark):
    rows = [(i, f"text number {i} of l{i % 300}", f"l{i % 300}") for i in range(1_500)] + [(5_000 + i, "words and words", "big") for i in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    usable = {r.lang for r in docs.filter(L.learnable(docs.doc_id)).collect()}
    for limit, quota in ((4_000, 4_000 // len(usable)), (10, 1)):
        taken = L.training_windows(docs, limit=limit)
        assert {language for language, _ in taken} == usable and len(usable) > 290
        assert sum(language == "big" for language, _ in taken) <= quota * L.TRAIN_WINDOWS
    assert L.train(docs.filter("false")) is None


def test_probabilities_against_a_plain_convolution():
    rng = np.random.default_rng(2)
    net = L.ByteNet.fresh(["a", "b", "c"])
    texts = [rng.integers(1, 255, n, dtype=np.uint8) for n in (L.WINDOW, 40, 3)]
    windows = np.zeros((3, L.WINDOW), np.uint8)
    for row, text in zip(windows, texts, strict=True):
        row[: len(text)] = text
    got = net.probabilities(windows)
    for window, own in zip(L.folded(windows), got, strict=True):
        pooled = []
        for width, filters, offset in zip(L.WIDTHS, net.filters, net.offsets, strict=True):
            responses = [np.concatenate([net.embedding[b] for b in window[i : i + width]]) @ filters for i in range(L.WINDOW - width + 1)]
            pooled.append(np.maximum(np.max(responses, axis=0) + offset, 0))
        score = np.concatenate(pooled) @ net.weights + net.bias
        want = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        assert own == pytest.approx(want, rel=1e-3, abs=1e-5)
