"""SentencePiece encoding and decoding through a table of distinct chunks."""

from __future__ import annotations

import re
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.batches import list_column, map_batches, row_schema, text_slices, texts
from lodestone.llm.chunks import IdTable, flatten, worker_table

#: Text bytes coded at once: ids and decoded texts take several times as much.
CODED_BYTES = 1 << 20

MARK = "▁"  # stands for a space inside pieces
#: A chunk: spaces and what follows them up to the next space.
_CHUNK = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")


def inner_marks(model: bytes) -> list[str]:
    """Pieces of a model that hold a space mark after another character. Chunks are exact only without any."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(model)
    return [p.piece for p in proto.pieces if MARK in p.piece.lstrip(MARK)]


def chunk_model(model: bytes) -> bytes:
    """The model for one chunk: the same pieces and scores, but no space is put before a text.

    Raises ``ValueError`` for a model whose chunks can't be told apart from the text alone: one that changes characters
    or white space first, puts no space before a text, holds pieces defined by its user, or pieces that cross a space."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(model)
    spec = proto.normalizer_spec
    plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces
    defined = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in proto.pieces)
    if not plain or not spec.escape_whitespaces or defined or proto.trainer_spec.treat_whitespace_as_suffix or inner_marks(model):
        raise ValueError("pieces of this model may cross or change white space")
    spec.add_dummy_prefix = False
    return proto.SerializeToString()


class ChunkTable:
    """Distinct chunks, each segmented and decoded once."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table = IdTable(self._segment)
        self.surfaces: list[str] = []

    def _segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = self.processor.encode(chunks, num_threads=1)
        decoded = self.processor.decode(parts)
        self.table.bytes += sum(map(getsizeof, decoded))
        self.surfaces.extend(decoded)
        return flatten(parts)

    def encode(self, documents: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The ids of all texts one after another, each text's number of ids, and its decoded text."""
        own = [_CHUNK.findall(" " + text) if text else [] for text in documents]
        every = [c for chunks in own for c in chunks]
        if self.table.full:
            self.table.clear()
            self.surfaces.clear()
        rows = self.table.rows_of(every)
        surface, at, decoded = self.surfaces, rows.tolist(), []
        start = 0
        for chunks in own:
            stop = start + len(chunks)
            decoded.append("".join([surface[r] for r in at[start:stop]])[1:])  # without the space put before the text
            start = stop
        return self.table.take(rows), self.table.sizes_of(rows, list(map(len, own))), decoded


def encode_and_decode(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(<doc_id>, ids array<int>, decoded string)``, one for each row of ``docs``, as the sentencepiece library
    encodes the whole text with ``model`` (a model file's bytes) and decodes the ids again.

    No piece of such a model goes over from a character to a following space, so a text falls into chunks (spaces and what follows
    up to the next space) that are segmented on their own. Each task keeps a table of the distinct chunks it has met:
    a chunk is segmented once, and ids are joined back by position. Nothing is shuffled; the table's size is
    bounded and it starts anew when full, which changes no result.

    A null or empty text has no ids and decodes to the empty text. Repeated rows give repeated results, an empty table
    gives no rows, and columns other than the two named are not looked at. Any length of text is worked on whole.
    """
    small = docs.sparkSession.sparkContext.broadcast(chunk_model(model))  # one model file
    schema = row_schema(docs, doc_id, "ids array<int>, decoded string")

    def run(batches):
        table = worker_table(("codec", small.value), lambda: ChunkTable(small.value))
        for part in text_slices(batches, limit=CODED_BYTES):
            ids, sizes, decoded = table.encode(texts(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), list_column(ids, sizes), pa.array(decoded, pa.string())], names=schema.names
            )

    return map_batches(docs.select(docs[doc_id].alias("key"), docs[text].alias("text")), run, schema)
