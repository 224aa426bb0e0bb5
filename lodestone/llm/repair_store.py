"""A store of token ids compressed by Re-Pair grammars, with access to any range of ids."""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.batches import map_batches, ranges, raw_texts, text_slices
from lodestone.llm.chunks import HashedIdTable, flatten, worker_table
from lodestone.llm.hashing import stretch_hashes

#: Ids of a shard, the unit with a grammar of its own; one longer document makes a shard of its own.
SHARD_IDS = 1 << 20
#: How often pairs are counted and replaced in a shard, and how many pairs at once.
ROUNDS, PAIRS = 4, 2048
#: A pair is frequent from this many occurrences in a shard on.
FREQUENT = 8

# white space in the sense of Unicode
_SPACES = frozenset(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# kinds of bytes: white space, letters, other signs of ASCII; 0 for the rest
_KIND = np.zeros(256, np.uint8)
_KIND[:0x80] = 3
_KIND[[*range(0x09, 0x0E), 0x20]] = 1
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 2
_KIND[0x30:0x3A] = 0


class TextEncoder:
    """The ids of whole texts, as the tokenizers library gives them with ``add_special_tokens=False``. A special token's name that stands
    in a text is text like any other, or with ``special_in_text``, the library's default, that token."""

    def __init__(self, tokenizer_json: str, special_in_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = not special_in_text
        self.tokenizer.model._resize_cache(0)  # the table sees to it that no chunk comes twice
        self.table = HashedIdTable(self._segment)
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and (special_in_text or not t.special)]
        # where white space may be part of a token, texts aren't cut at it
        self.splits = splits_at_space(tokenizer_json) and not any(_SPACES & set(t.content) for t in added)
        self.added = [t.content.encode() for t in added] if self.splits else []
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, number in vocabulary.items():  # byte-level: a character of a token stands for a byte
            self.token_bytes[number] = len(token)

    def _segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.splits:
            return flatten([e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)])
        # chunks that white space sets apart on both sides go through the library as one text; a token's
        # bytes tell to which chunk it belongs
        joined = np.array([c[0] in _SPACES and c[-1] not in _SPACES for c in chunks])
        together = [c for c, j in zip(chunks, joined, strict=True) if j]
        flat = [
            np.array(self.tokenizer.encode_batch_fast(["".join(together[i : i + 2000])], add_special_tokens=False)[0].ids, np.int32)
            for i in range(0, len(together), 2000)
        ]
        one = np.concatenate([*flat, np.empty(0, np.int32)])
        ends = np.cumsum(self.token_bytes[one])
        chunk_ends = np.cumsum([len(c.encode()) for c in together]).astype(np.int64)
        counts = np.diff(np.searchsorted(ends, chunk_ends, side="right"), prepend=0)
        apart = [c for c, j in zip(chunks, joined, strict=True) if not j]
        two, own = flatten([e.ids for e in self.tokenizer.encode_batch_fast(apart, add_special_tokens=False)])
        sizes = np.empty(len(chunks), np.int64)
        sizes[joined], sizes[~joined] = counts, own
        ids = np.empty(len(one) + len(two), np.int32)
        of_joined = np.repeat(joined, sizes)
        ids[of_joined], ids[~of_joined] = one, two
        return ids, sizes

    def encode(self, documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (as UTF-8) one after another, and each text's number of ids. Texts with an added token in them go
        through the library whole."""
        whole = [i for i, d in enumerate(documents) if any(t in d for t in self.added)]
        if not whole:
            return self._encode_chunks(documents)
        rest = list(documents)
        for i in whole:
            rest[i] = b""
        ids, sizes = self._encode_chunks(rest)
        own, counts = flatten([e.ids for e in self.tokenizer.encode_batch_fast([documents[i].decode() for i in whole], add_special_tokens=False)])
        places = np.repeat(np.cumsum(sizes)[whole], counts)
        sizes[whole] = counts
        return np.insert(ids, places, own), sizes

    def _encode_chunks(self, documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(documents)
        lengths = np.fromiter(map(len, documents), np.int64, len(documents))
        text_ends = np.cumsum(lengths)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(documents), np.int64)
        raw = np.frombuffer(joined, np.uint8)
        begins = chunk_begins(raw) if self.splits else np.zeros(len(raw), bool)
        begins[(text_ends - lengths)[lengths > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        if self.table.full:
            self.table.clear()

        def chunks_at(places: np.ndarray) -> list[str]:
            return [joined[a:b].decode() for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)]

        rows = self.table.rows_of_hashes(stretch_hashes(raw, starts, ends), chunks_at)
        counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
        return self.table.take(rows), self.table.sizes_of(rows, counts)


def chunk_begins(raw: np.ndarray) -> np.ndarray:
    """Where a text may be cut: no token goes on from another character into white space, nor from a letter into a sign."""
    kind = _KIND[raw]
    begins = np.zeros(len(raw), bool)
    begins[1:] = ((kind[1:] == 1) & (kind[:-1] != 1)) | ((kind[1:] == 3) & (kind[:-1] == 2))
    # white space outside ASCII before white space: not between characters of one run
    at = np.flatnonzero(begins[1:] & (raw[:-1] >= 0x80) & (kind[1:] == 1)) + 1
    one, two = raw[at - 1], raw[np.maximum(at - 2, 0)]
    three = raw[np.maximum(at - 3, 0)]
    wide = (
        ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
        | ((three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)))
        | ((three == 0xE2) & (two == 0x81) & (one == 0x9F))
        | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
        | ((three == 0xE1) & (two == 0x9A) & (one == 0x80))
    )
    begins[at[wide]] = False
    return begins


def splits_at_space(tokenizer_json: str) -> bool:
    """Whether texts may be cut before white space that follows another character: so it is for byte-level
    vocabularies with the usual split into words and nothing that changes the text before it."""
    data = json.loads(tokenizer_json)
    before = data.get("pre_tokenizer") or {}
    return (
        data.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
    )


#: Places of the table that finds a pair's rank.
_TABLE_BITS = 17


def _hashed(keys: np.ndarray) -> np.ndarray:
    """A place in the table for each pair."""
    if keys.dtype == np.uint64:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)
    return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - _TABLE_BITS)


class Grammar:
    """A sequence of symbols and rules ``symbol -> left right``. Symbols below ``terminals`` are ids; rule ``i`` makes symbol
    ``terminals + i`` from earlier symbols and stands for ``lengths[i]`` ids."""

    def __init__(self, terminals: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> None:
        self.terminals, self.rules, self.lengths, self.symbols = terminals, rules, lengths, symbols

    @classmethod
    def of(cls, ids: np.ndarray, terminals: int, rounds: int = ROUNDS, pairs: int = PAIRS, frequent: int = FREQUENT) -> Grammar:
        """Replace the most frequent pairs by new symbols, again and again. Of pairs that overlap the more frequent one
        is replaced, of equal ones the first."""
        rules: list[np.ndarray] = []
        lengths = np.ones(terminals, np.int64)
        made, seq = 0, ids
        for _ in range(rounds):
            top = terminals + made
            wide = top > 1 << 16
            number = np.uint64 if wide else np.uint32  # holds a pair of symbols below top
            seq = seq.astype(number, copy=False)
            keys = seq[:-1] * number(top) + seq[1:]
            ordered = np.sort(keys)
            at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
            counts = np.diff(np.append(at, len(ordered)))
            often = np.flatnonzero(counts >= frequent)
            room = pairs if wide or terminals >= 1 << 16 else min(pairs, (1 << 16) - top)
            best = often[np.argsort(-counts[often], kind="stable")][:room]
            if not len(best):
                break
            chosen = ordered[at[best]]
            # a hashed table from pair to rank; a pair whose place a more frequent one has waits for the next round
            table = np.full(1 << _TABLE_BITS, len(chosen), np.int32)
            table[_hashed(chosen)[::-1]] = np.arange(len(chosen) - 1, -1, -1)
            ranks = table[_hashed(keys)]
            where = np.flatnonzero(np.append(chosen, ~chosen[:1])[ranks] == keys)
            rank = ranks[where]
            real = rank < len(chosen)
            where, rank = where[real], rank[real]
            # of a run of one pair every second place counts; then of neighbours the more frequent pair wins
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(where) != 1) | (np.diff(rank) != 0)]))
            places = np.arange(len(where)) - np.repeat(begins, np.diff(np.append(begins, len(where))))
            where, rank = where[places % 2 == 0], rank[places % 2 == 0]
            near = np.flatnonzero(np.diff(where) == 1)
            earlier = rank[near] < rank[near + 1]
            lose = np.zeros(len(where), bool)
            lose[near[earlier] + 1] = True
            lose[near[~earlier]] = True
            where, rank = where[~lose], rank[~lose]
            used = np.flatnonzero(np.bincount(rank, minlength=len(chosen)))
            renumber = np.zeros(len(chosen), np.int64)
            renumber[used] = np.arange(len(used))
            picked = chosen[used]
            left, right = (picked // number(top)).astype(np.int64), (picked % number(top)).astype(np.int64)
            rules.append(np.stack([left, right], axis=1))
            lengths = np.concatenate([lengths, lengths[left] + lengths[right]])
            seq = seq.copy()
            seq[where] = (top + renumber[rank]).astype(number)
            keep = np.ones(len(seq), bool)
            keep[where + 1] = False
            seq = seq[keep]
            made += len(used)
        every = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
        return cls(terminals, every, lengths[terminals:], seq.astype(np.int64))

    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all symbols one after another, with the start and length of each symbol's."""
        sizes = np.concatenate([np.ones(self.terminals, np.int64), self.lengths])
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int64)
        flat[: self.terminals] = np.arange(self.terminals)
        for i, (left, right) in enumerate(self.rules.tolist(), self.terminals):
            a, n, m = starts[i], sizes[left], sizes[right]
            flat[a : a + n] = flat[starts[left] : starts[left] + n]
            flat[a + n : a + n + m] = flat[starts[right] : starts[right] + m]
        return flat, starts, sizes

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids at ``start .. stop - 1``; only the symbols that cover them are expanded."""
        flat, starts, sizes = self.expansions()
        ends = np.cumsum(sizes[self.symbols])
        total = int(ends[-1]) if len(ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.empty(0, np.int64)
        first = int(np.searchsorted(ends, start, side="right"))
        last = int(np.searchsorted(ends, stop, side="left")) + 1
        symbols = self.symbols[first:last]
        skip = start - (int(ends[first - 1]) if first else 0)
        return flat[ranges(starts[symbols], sizes[symbols])][skip : skip + stop - start]

    def pack(self) -> tuple[bytes, bytes, bytes]:
        """Rules, expansion lengths and symbols as little-endian unsigned numbers; symbols of 2 bytes if all fit, else of 4."""
        symbol = "<u2" if self.terminals + len(self.rules) <= 1 << 16 else "<u4"
        return (
            self.rules.astype("<u4").tobytes(),
            self.lengths.astype("<u4").tobytes(),
            self.symbols.astype(symbol).tobytes(),
        )

    @classmethod
    def unpack(cls, terminals: int, rules: bytes, lengths: bytes, symbols: bytes) -> Grammar:
        made = np.frombuffer(rules, "<u4").reshape(-1, 2).astype(np.int64)
        symbol = "<u2" if terminals + len(made) <= 1 << 16 else "<u4"
        return cls(terminals, made, np.frombuffer(lengths, "<u4").astype(np.int64), np.frombuffer(symbols, symbol).astype(np.int64))


FORMAT = "part int, shard int, n_ids long, terminals int, rules binary, lengths binary, symbols binary, doc_ids array<{key}>, doc_sizes array<int>"


def write_store(
    docs: DataFrame, path: str, tokenizer_json: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS,
    special_in_text: bool = False,
) -> None:
    """Encode every document of ``docs``, append ``end_id`` to each, and write the ids to ``path`` in ascending order of the key.

    The store is a Parquet table with a row for each shard: consecutive documents of about ``shard_ids`` ids under one
    Re-Pair grammar (rules, expansion lengths and symbols as packed numbers), the documents' keys and their numbers of ids, and
    the shard's place (``part``, ``shard``), by which shards are in the order of their documents.

    Null and empty texts have the end id alone. Null keys come first; rows of one key are in the order of a hash of the text, and a key
    with many rows is dealt out by it. ``special_in_text``: whether the name of a special token in a text gives that token, as with the
    library's defaults, or the ids of its letters. An empty table makes a store without rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("key"), F.xxhash64(text).alias("order"), F.col(text).alias("text"))
    key_type = docs.select(doc_id).schema[0].dataType.simpleString()
    schema = StructType.fromDDL(FORMAT.format(key=key_type))
    ordered = rows.repartitionByRange("key", "order").sortWithinPartitions("key", "order")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file

    def run(batches):
        source = shared.value, special_in_text
        encoder, part = worker_table(("ids", *source), lambda: TextEncoder(*source)), TaskContext.get().partitionId()
        terminals = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        ids, keys, sizes, held, number = [], [], [], 0, 0

        def shard():
            flat = np.concatenate(ids)
            packed = Grammar.of(flat, terminals).pack()
            own = pa.array([pa.concat_arrays(keys).to_pylist()], schema_type(schema, "doc_ids"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([len(flat)], pa.int64()),
                    pa.array([terminals], pa.int32()),
                    *(pa.array([x], pa.binary()) for x in packed),
                    own,
                    pa.array([np.concatenate(sizes).tolist()], pa.list_(pa.int32())),
                ],
                names=schema.names,
            )

        for batch in text_slices(batches):
            flat, counts = encoder.encode(raw_texts(batch.column("text")))
            flat = np.insert(flat, np.cumsum(counts), end_id)
            ids.append(flat)
            keys.append(batch.column("key"))
            sizes.append(counts + 1)
            held += len(flat)
            if held >= shard_ids:
                yield shard()
                ids, keys, sizes, held, number = [], [], [], 0, number + 1
        if ids:
            yield shard()

    map_batches(ordered, run, schema).write.parquet(path)


def schema_type(schema: StructType, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(schema[name].dataType)


def read_store(spark: SparkSession, path: str, doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The documents of a store: ``(<doc_id>, start, n_tokens, ids_crc32)`` and, if asked for, ``ids``. ``start`` is the number of ids
    before the document in the whole store, ``ids_crc32`` the unsigned checksum of its ids as little-endian 32-bit numbers."""
    store = spark.read.parquet(path)
    key_type = store.schema["doc_ids"].dataType.elementType.simpleString()
    ddl = f"part int, shard int, key {key_type}, local_start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    schema = StructType.fromDDL(ddl)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pydict()
                grammar = Grammar.unpack(row["terminals"][0], row["rules"][0], row["lengths"][0], row["symbols"][0])
                ids = grammar.decode().astype("<u4")
                sizes = np.array(row["doc_sizes"][0], np.int64)
                ends = np.cumsum(sizes)
                spans = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
                columns = [
                    pa.array(np.full(len(sizes), row["part"][0], np.int32)),
                    pa.array(np.full(len(sizes), row["shard"][0], np.int32)),
                    pa.array(row["doc_ids"][0], schema_type(schema, "key")),
                    pa.array(ends - sizes),
                    pa.array(sizes),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in spans], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    documents = map_batches(store.drop("n_ids"), run, schema)
    # ids before each part (as many rows as tasks that wrote), then before each shard of a part
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    shards = store.select(
        F.col("part").alias("in_part"),
        F.col("shard").alias("in_shard"),
        (F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("before_shard"),
    )
    places = shards.join(parts, F.col("in_part") == F.col("part")).select(
        "in_part", "in_shard", (F.col("before_part") + F.col("before_shard")).alias("before")
    )
    placed = documents.join(places, (F.col("part") == F.col("in_part")) & (F.col("shard") == F.col("in_shard")))
    return placed.select(
        F.col("key").alias(doc_id),
        (F.col("before") + F.col("local_start")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )


def read_range(spark: SparkSession, path: str, part: int, shard: int, start: int, stop: int) -> list[int]:
    """Ids ``start .. stop - 1`` of one shard: one row is read, and only the symbols over the range are expanded."""
    row = spark.read.parquet(path).filter((F.col("part") == part) & (F.col("shard") == shard)).first()
    if row is None:
        return []
    return Grammar.unpack(row.terminals, row.rules, row.lengths, row.symbols).decode(start, stop).tolist()
