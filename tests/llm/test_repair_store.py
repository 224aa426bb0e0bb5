import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import repair_store as R
from lodestone.llm.queries import op6_repair_store, tokenizer_file

SF = "/root/testdata/sf0.001"
VOCABULARY = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_str(tokenizer_file(VOCABULARY).decode())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_grammar_round_trip_and_ranges():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 5000):
        for terminals in (5, 50_257, 70_000):
            for letters in (1, 2, 4):
                ids = rng.integers(0, letters, n)
                grammar = R.Grammar.unpack(terminals, *R.Grammar.of(ids, terminals, frequent=2).pack())
                assert grammar.decode().tolist() == ids.tolist()
                a, b = sorted(rng.integers(0, n + 2, 2).tolist())
                assert grammar.decode(a, b).tolist() == ids[a:b].tolist()
                if n == 5000:
                    assert len(grammar.symbols) < n / 2 and len(grammar.rules)
                    assert grammar.lengths.sum() > 0


def test_chunks_match_the_library(library):
    encoder = R.TextEncoder(tokenizer_file(VOCABULARY).decode())
    rng = random.Random(5)
    letters = " \t\n\r\x0b\x85\xa0\u2003\u3000 abT'sll're123é²½中.!?<|endoftext|>\x1c\x1d\u200b\xad\u0301😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    ids, sizes = encoder.encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library(t) for t in texts]


def check(found, documents, library):
    """In the order of ids every document starts where the one before ends."""
    at, want = 0, []
    for i, text in documents:
        ids = [*library(text), 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found), key=lambda r: r[1]) == want


def test_query(spark, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    check(op6_repair_store(spark, SF).collect(), docs, library)


@pytest.mark.parametrize("shard_ids", [1 << 20, 40])
def test_awkward_rows(spark, awkward, none_at_all, library, tmp_path, shard_ids):
    source, path = tokenizer_file(VOCABULARY).decode(), str(tmp_path / "store")
    R.write_store(awkward, path, source, 2, shard_ids=shard_ids)
    found = R.read_store(spark, path, with_ids=True).orderBy("start").collect()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in found]
    assert keys == sorted(keys)
    assert sorted(r.ids for r in found) == sorted([*library(r.text), 2] for r in awkward.collect())
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    first = spark.read.parquet(path).orderBy("part", "shard").first()
    every = [i for r in found for i in r.ids]
    assert R.read_range(spark, path, first.part, first.shard, 3, 9) == every[: first.n_ids][3:9]
    R.write_store(none_at_all, path + "-none", source, 2)
    assert R.read_store(spark, path + "-none").collect() == []


def test_query_reads_added_tokens_as_the_untouched_library(spark, tmp_path):
    token = "<|endoftext|>"
    texts = [f"a {token} b", token, f"x{token}{token}\n y", "plain text, as before", "", None, f"<|endof text|> {token[:-1]}", f"é {token}\u3000 'll"]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    untouched = Tokenizer.from_str(tokenizer_file(VOCABULARY).decode())
    library = lambda text: untouched.encode(text or "", add_special_tokens=False).ids
    assert library(texts[0]) == [64, 220, 50256, 275]
    check(op6_repair_store(spark, str(tmp_path)).collect(), docs, library)
