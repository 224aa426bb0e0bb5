import hashlib
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from lodestone.llm import chunk_codec as C
from lodestone.llm import chunks
from lodestone.llm.queries import op10_chunk_table, tokenizer_file

SF = "/root/testdata/sf0.001"
MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=tokenizer_file(MODEL))


def test_random_texts(library):
    table = C.ChunkTable(C.chunk_model(tokenizer_file(MODEL)))
    rng = random.Random(3)
    letters = " \u2581  \n\tabthe.é中😀\u0301<s>\x01\x00\r0129ß"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        ids, _, decoded = table.encode([text])
        want = library.encode(text)
        assert ids.tolist() == want and decoded == [library.decode(want)]


def test_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op10_chunk_table(spark, SF).collect():
        ids = library.encode(docs[r.doc_id])
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_awkward_rows(spark, awkward, none_at_all, library, monkeypatch):
    model = tokenizer_file(MODEL)
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in C.encode_and_decode(awkward, model).collect()), key=repr)
    ids = [(r.doc_id, library.encode(r.text or "")) for r in awkward.collect()]
    assert got == sorted(((i, x, library.decode(x)) for i, x in ids), key=repr)
    assert C.encode_and_decode(none_at_all, model).collect() == []


def test_table_starts_anew_when_full(library, monkeypatch):
    monkeypatch.setattr(chunks, "TABLE_BYTES", 1_000)
    table = C.ChunkTable(C.chunk_model(tokenizer_file(MODEL)))
    for text in ("one two three four", "five one", "two two six", "x" * 5_000, "one"):
        ids, _, decoded = table.encode([text])
        assert ids.tolist() == library.encode(text) and decoded == [text]
    assert len(table.surfaces) == len(table.table.rows) == 1  # one long chunk fills it too


def test_a_worker_keeps_one_table():
    assert chunks.worker_table(("a", 1), list) is chunks.worker_table(("a", 1), list)
    held = chunks.worker_table(("a", 1), list)
    assert chunks.worker_table(("b", 1), list) is not held and chunks.worker_table(("a", 1), list) is not held


def test_other_models_are_refused():
    proto = pb.ModelProto.FromString(tokenizer_file(MODEL))
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        C.chunk_model(proto.SerializeToString())
    proto = pb.ModelProto.FromString(tokenizer_file(MODEL))
    proto.pieces[1000].piece = "a\u2581b"
    with pytest.raises(ValueError):
        C.chunk_model(proto.SerializeToString())
