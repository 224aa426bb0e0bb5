"""A sparse document-term matrix: a dictionary of all words, and shards of compressed rows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lodestone.llm.batches import SLICE_BYTES, lengths, map_batches, raw_texts, text_slices
from lodestone.materialize import materialize

#: Text bytes of a shard; a longer text makes a shard of its own.
SHARD_BYTES = 16 << 20
#: Words of the dictionary whose hash is another word's too, as many as every task may hold. Fewer than one is to be expected up to 10^9 words.
SHARED_HASHES = 1_000_000
#: Bits of a word's hash; words that share one have numbers above.
HASH_BITS = 62

#: A value of each row from a slice's bytes and the places where its texts start and end.
Measure = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Words:
    """Numbers for words in the order in which they are met."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)

    def __len__(self) -> int:
        return len(self.number)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def column(self) -> pa.ListArray:
        return list_column_of(pa.array(list(self.number), pa.binary()))


def list_column_of(values: pa.Array) -> pa.ListArray:
    """A column of one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _shards(docs: DataFrame, text: str, carried: dict[str, Column], measures: dict[str, Measure], shard_bytes: int, hash_bits: int) -> DataFrame:
    """Shards with their words and the words' hashes besides what the matrix has."""
    rows = docs.select(*[c.alias(k) for k, c in carried.items()], F.col(text).alias("__text"))
    fields = [StructField(f.name, ArrayType(f.dataType)) for f in rows.drop("__text").schema.fields]
    fields += StructType.fromDDL(", ".join(f"{k} array<long>" for k in measures)).fields if measures else []
    plain = "shard long, words array<binary>, terms array<long>, sizes array<int>, columns array<int>, counts array<int>"
    schema = StructType([*StructType.fromDDL(plain).fields, *fields])
    names = list(carried)

    def run(batches) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), [], 0
        shard = TaskContext.get().partitionId() << 33

        def whole() -> pa.RecordBatch:
            arrays = [np.concatenate([h[i] for h in held]).astype(np.int32) for i in range(3)]
            values = [pa.concat_arrays([h[3].column(n) for h in held]) for n in names]
            values += [pa.array(np.concatenate([h[4][k] for h in held])) for k in measures]
            terms = np.fromiter(map(xxhash.xxh3_64_intdigest, words.number), np.uint64, len(words)) & np.uint64((1 << hash_bits) - 1)
            lists = [list_column_of(pa.array(a)) for a in (terms.astype(np.int64), *arrays)]
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), words.column(), *lists, *map(list_column_of, values)], names=schema.names)

        for part in text_slices(batches, "__text", min(SLICE_BYTES, shard_bytes)):
            sizes = lengths(part.column("__text"))
            if held and size + int(sizes.sum()) > shard_bytes:
                yield whole()
                words, held, size, shard = Words(), [], 0, shard + 1
            bodies = raw_texts(part.column("__text"))
            lists = [body.split() for body in bodies]
            per_row = np.fromiter(map(len, lists), np.int64, len(lists))
            numbers = words.numbers(list(chain.from_iterable(lists)))
            wide = max(1, len(words))
            cells, counts = np.unique(np.repeat(np.arange(len(lists)) * wide, per_row) + numbers, return_counts=True)
            of, column = np.divmod(cells, wide)
            ends = np.cumsum(sizes)
            raw = np.frombuffer(b"".join(bodies), np.uint8)
            measured = {k: measure(raw, ends - sizes, ends).astype(np.int64) for k, measure in measures.items()}
            held.append((np.bincount(of, minlength=len(lists)), column, counts, part.select(names), measured))
            size += int(sizes.sum())
        if held:
            yield whole()

    return map_batches(rows, run, schema)


def count_bytes(which: np.ndarray) -> Measure:
    """How many bytes of each text are among ``which``, a table of 256 booleans."""

    def measure(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(which[raw], dtype=np.int64)])
        return sums[ends] - sums[starts]

    return measure


def _dictionary(shards: DataFrame) -> tuple[DataFrame, list[bytes]]:
    """The dictionary ``(word, id)``, and the words that share a hash with another one, in their order."""
    listed = shards.select(F.explode(F.arrays_zip("words", "terms")).alias("w")).select("w.words", "w.terms")
    words = materialize(listed.groupBy(F.col("words").alias("word")).agg(F.min("terms").alias("id")), "dictionary")
    shared = words.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("of"))
    among = words.join(shared, F.col("id") == F.col("of")).select("word").limit(SHARED_HASHES + 1)
    clashing = sorted(bytes(r.word) for r in among.collect())
    if len(clashing) > SHARED_HASHES:
        raise ValueError("too many words share a hash")
    return words, clashing


def document_term_matrix(
    docs: DataFrame,
    carried: dict[str, Column],
    text: str = "text",
    measures: dict[str, Measure] | None = None,
    shard_bytes: int = SHARD_BYTES,
    hash_bits: int = HASH_BITS,
) -> tuple[DataFrame, DataFrame]:
    """The dictionary ``(word, id)`` of all words of ``docs``, and the shards of their matrix: ``(shard, terms, sizes, columns, counts, <carried>, <measures>)``.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, in the case that they have. A shard is one row with compressed sparse rows over the shard's own columns, whose
    ids ``terms`` has: the ``i``-th document has the next ``sizes[i]`` places of ``columns`` and ``counts``, and the ``i``-th value of each of ``carried``, whatever
    columns of ``docs`` those are, and of ``measures``, which are worked out from its bytes. So every row of ``docs`` is in one shard, a repeated one again.

    An id is the word's hash, so that tasks number words alike without a look into the dictionary, and occurrences need not meet it in a join. That a number has
    one word only is made sure over the whole dictionary; words that share a hash (hardly ever any) get numbers of their own, which are sent to
    every task if there are at most ``SHARED_HASHES``; more are an error. Only the shards' distinct words are shuffled.

    Null and empty texts are rows without pairs; an empty table gives an empty dictionary and no shards.
    """
    shards = materialize(_shards(docs, text, carried, measures or {}, shard_bytes, hash_bits), "term_shards")
    words, clashing = _dictionary(shards)
    if not clashing:
        return words, shards.drop("words")
    numbers = docs.sparkSession.sparkContext.broadcast({w: (1 << hash_bits) + i for i, w in enumerate(clashing)})

    def renumber(words_column: str, ids: str, lists: bool):
        def run(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, given = batch.column(words_column), batch.column(ids)
                flat_words, flat = (own.flatten(), given.flatten()) if lists else (own, given)
                known = numbers.value
                fresh = pa.array([known.get(w, i) for w, i in zip(flat_words.to_pylist(), flat.to_pylist(), strict=True)], pa.int64())
                fresh = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(given.value_lengths().to_numpy())), pa.int32()), fresh) if lists else fresh
                at = batch.schema.get_field_index(ids)
                yield batch.set_column(at, ids, fresh)

        return run

    words = map_batches(words, renumber("word", "id", False), words.schema)
    return words, map_batches(shards, renumber("words", "terms", True), shards.schema).drop("words")


def row_sums(matrix: DataFrame, kept: list[str]) -> DataFrame:
    """Rows ``(<kept>, n_words, n_distinct)`` for each row of the matrix: the sum of its counts and how many there are."""
    rows = matrix.select(*kept, "sizes", "counts")
    plain = [StructField(f.name, f.dataType.elementType) for f in rows.select(*kept).schema.fields]
    schema = StructType([*plain, *StructType.fromDDL("n_words long, n_distinct long").fields])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in (batch.slice(i, 1) for i in range(batch.num_rows)):
                sizes = shard.column("sizes").flatten().to_numpy().astype(np.int64)
                sums = np.concatenate([[0], np.cumsum(shard.column("counts").flatten().to_numpy().astype(np.int64))])
                ends = np.cumsum(sizes)
                values = [shard.column(n).flatten() for n in kept]
                yield pa.RecordBatch.from_arrays([*values, pa.array(sums[ends] - sums[ends - sizes]), pa.array(sizes)], names=schema.names)

    return map_batches(rows, run, schema)
