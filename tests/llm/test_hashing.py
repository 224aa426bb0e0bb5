import numpy as np

from lodestone.llm import hashing as H


def test_equal_stretches_have_equal_hashes_wherever_they_stand(monkeypatch):
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(0, 3, rng.integers(0, 6), dtype=np.uint8)) for _ in range(3000)]
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - np.array([len(w) for w in words])
    whole = H.stretch_hashes(raw, starts, ends)
    monkeypatch.setattr(H, "BLOCK", 10)
    assert (H.stretch_hashes(raw, starts, ends) == whole).all()
    by_word = dict(zip(words, whole.tolist(), strict=True))
    assert [by_word[w] for w in words] == whole.tolist() and len(set(by_word.values())) == len(by_word)
    assert len(H.stretch_hashes(raw, starts[:0], ends[:0])) == 0
