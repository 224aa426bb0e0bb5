"""Benchmark decontamination: Wu-Manber search for windows of benchmark words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import list_column, map_batches, raw_texts, text_slices
from lodestone.llm.chunks import worker_table
from lodestone.materialize import materialize

WINDOW = 10
#: Benchmark bytes whose tables a task holds at once, about 200 bytes for each; a larger benchmark is searched for in several passes.
BLOCK_BYTES = 512 << 10
#: Words that make up a block of the shift table.
BLOCK_WORDS = 2

_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z are lowered) and all that is not ASCII."""
    return text.translate(_FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    """All runs of ``size`` words; fewer words, but not none, are one window."""
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield tuple(words[i : i + size])


@dataclass
class _Class:
    """The tables of all patterns of one length: how far a block lets the search move on, and by the last
    block's hash and then the first block's, the patterns that may end there."""

    size: int
    block: int
    shifts: dict[int, int]
    buckets: dict[int, dict[int, list[tuple[tuple[bytes, ...], tuple[str, ...]]]]]


class WindowSearch:
    """Wu-Manber search over words for the windows of ``items`` (number, text)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for number, text in items:
            for pattern in windows_of(words_of(text), window):
                owners[pattern].add(number)
        by_size: dict[int, dict] = defaultdict(dict)
        for pattern, own in owners.items():
            by_size[len(pattern)][pattern] = tuple(sorted(own))
        self.classes = [self._tables(size, patterns) for size, patterns in sorted(by_size.items())]

    @staticmethod
    def _tables(size: int, patterns: dict) -> _Class:
        block = min(BLOCK_WORDS, size)
        shifts: dict[int, int] = {}
        buckets: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for pattern, own in patterns.items():
            for end in range(block, size + 1):
                h = hash(pattern[end - block : end])
                shifts[h] = min(shifts.get(h, size), size - end)
            buckets[hash(pattern[size - block :])][hash(pattern[:block])].append((pattern, own))
        return _Class(size, block, shifts, {suffix: dict(by_prefix) for suffix, by_prefix in buckets.items()})

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans (start, end) of all occurrences in ascending order for each pattern length, and the items found."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        n = len(words)
        for c in self.classes:
            size, block, buckets = c.size, c.block, c.buckets
            shift_of, skip = c.shifts.get, size - block + 1
            end = size
            while end <= n:
                h = hash(tuple(words[end - block : end]))
                shift = shift_of(h, skip)
                if shift:
                    end += shift
                    continue
                here = tuple(words[end - size : end])
                for pattern, own in buckets[h].get(hash(here[:block]), ()):
                    if pattern == here:
                        spans.append((end - size, end))
                        found.update(own)
                end += 1
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint ones in ascending order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The items with text in blocks of about ``block_bytes``, dealt by a hash of id and text."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    items = items.filter(F.col("text").isNotNull() & F.col("item").isNotNull())
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    if n == 1:
        return [items]
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [items.filter(block == i) for i in range(n)]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    item_id: str = "item_id",
    text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with three more columns: ``n_words`` of the text, ``hit_spans`` (disjoint spans of words, ascending, as
    ``start, end, start, end ...``) that lie inside an occurrence of a window of a benchmark item, and ``hit_items`` (the
    ids of the items with such windows as strings, ascending). Columns of these names are replaced.

    The benchmark is the stated query set: its tables go to every task, in blocks of about ``block_bytes`` of item text. A larger
    benchmark takes one pass over the documents for each block, and the passes' spans are united row by row, so
    no document is shuffled. Rows keep all their columns; each task searches slices of a few MB of text.

    A null or empty text has no words and no hits. A null item id or text, or an item without words, can't be hit; repeated items
    count once. An empty benchmark hits nothing and an empty table gives no rows.
    """
    added = ("n_words", "hit_spans", "hit_items")
    kept = [c for c in docs.columns if c not in added]
    # positions stand for names, so that columns may be called anything
    state = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("hit_spans"),
        F.array().cast("array<string>").alias("hit_items"),
    )
    schema, at = state.schema, kept.index(text)
    blocks = item_blocks(benchmark, item_id, text, block_bytes)
    for number, block in enumerate(blocks):
        rows = block.collect()  # one block of the benchmark: its size is checked above
        items = docs.sparkSession.sparkContext.broadcast([(r.item, r.text.encode()) for r in rows])
        state = map_batches(state, _pass(items, at, schema.names, window), schema)
        if number + 1 < len(blocks):
            state = materialize(state, "decontaminate")
    return state


def _pass(items, at: int, names: list[str], window: int):
    def run(batches):
        own = items.value  # kept with its tables, so that its identity stays its own
        search = worker_table(("windows", id(own), window), lambda: (own, WindowSearch(own, window)))[1]
        for part in text_slices(batches, names[at]):
            n = part.num_columns
            counts, spans, sizes, ids = [], [], [], []
            before = zip(part.column(n - 2).to_pylist(), part.column(n - 1).to_pylist(), strict=True)
            for body, (old_spans, old_items) in zip(raw_texts(part.column(at)), before, strict=True):
                words = words_of(body)
                hits, found = search.find(words)
                hits += zip(old_spans[::2], old_spans[1::2], strict=True)
                flat = [x for span in merged(hits) for x in span] if hits else []
                counts.append(len(words))
                spans.extend(flat)
                sizes.append(len(flat))
                ids.append(sorted(found.union(old_items)))
            new = [
                pa.array(counts, pa.int64()),
                list_column(np.array(spans, np.int32), np.array(sizes, np.int64)),
                pa.array(ids, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*part.columns[: n - 3], *new], names=names)

    return run


def hit_words(spans="hit_spans"):
    """Number of words in spans."""
    ends = F.filter(spans, lambda _, i: i % 2 == 1)
    starts = F.filter(spans, lambda _, i: i % 2 == 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return total(ends) - total(starts)
