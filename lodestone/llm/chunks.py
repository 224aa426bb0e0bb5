"""A worker's table of distinct text chunks and their ids."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat
from sys import getsizeof

import numpy as np

from lodestone.llm.batches import ranges

#: Bytes that a worker's table may take, its chunks included, before it starts anew; results don't depend on it.
TABLE_BYTES = 32 << 20
_latest: list = []


def worker_table(key: tuple, build: Callable[[], object]):
    """The table that a worker keeps for its later tasks. There is one at a time: another stage's table goes when a task asks for its own."""
    if not _latest or _latest[0] != key:
        _latest.clear()
        _latest[:] = [key, build()]
    return _latest[1]


class IdTable:
    """Distinct chunks, each segmented once by ``segment``, a function from a list of chunks
    to all their ids one after another and each one's number of ids."""

    def __init__(self, segment: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.segment = segment
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)
        self.bytes = 0

    @property
    def full(self) -> bool:
        return self.bytes > TABLE_BYTES

    def rows_of(self, chunks: list[str]) -> np.ndarray:
        """The row of each chunk; those that the table doesn't hold are segmented and added."""
        at = np.fromiter(map(self.rows.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            fresh = list(dict.fromkeys([chunks[i] for i in missing]))
            self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self._append(fresh)
            at[missing] = [self.rows[chunks[i]] for i in missing]
        return at

    def _append(self, fresh: list[str]) -> None:
        flat, sizes = self.segment(fresh)
        self.bytes += flat.nbytes + self._entry_bytes(fresh)
        ends = np.cumsum(sizes) + len(self.ids)
        self.ids = np.concatenate([self.ids, flat])
        self.starts = np.concatenate([self.starts, ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])

    def _entry_bytes(self, fresh: list[str]) -> int:
        """What chunks take besides their ids: themselves, a place in the dictionary and in the arrays."""
        return sum(map(getsizeof, fresh)) + 160 * len(fresh)

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the chunks at ``rows``, one after another."""
        return self.ids[ranges(self.starts[rows], self.sizes[rows])]

    def sizes_of(self, rows: np.ndarray, counts: np.ndarray | list[int]) -> np.ndarray:
        """Ids of each text, where text ``i`` has the next ``counts[i]`` of ``rows``."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[rows])])
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return np.diff(ends[bounds])


class HashedIdTable(IdTable):
    """A table whose chunks are told apart by 64-bit hashes, so that a slice's chunks are looked up as arrays."""

    def clear(self) -> None:
        super().clear()
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.main, self.recent = none, none  # sorted hashes and their rows

    def __len__(self) -> int:
        return len(self.sizes)

    def _entry_bytes(self, fresh: list[str]) -> int:
        return 40 * len(fresh)  # chunks aren't held

    def rows_of_hashes(self, hashes: np.ndarray, chunks_at: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """The row of each hash; ``chunks_at`` gives the chunks at some places of ``hashes``, for those that are new."""
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        rows = np.full(len(distinct), -1, np.int64)
        for known, own in (self.main, self.recent):
            open_ = np.flatnonzero(rows < 0)
            if len(known) and len(open_):
                at = np.minimum(np.searchsorted(known, distinct[open_]), len(known) - 1)
                hit = known[at] == distinct[open_]
                rows[open_[hit]] = own[at[hit]]
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            rows[fresh] = np.arange(len(self), len(self) + len(fresh))
            self._append(chunks_at(first[fresh]))
            self.recent = _merged(self.recent, (distinct[fresh], rows[fresh]))
            if len(self.recent[0]) > 1 << 16:
                self.main, self.recent = _merged(self.main, self.recent), (distinct[:0], rows[:0])
        return rows[back.reshape(-1)]


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, rows = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")  # two sorted runs
    return keys[order], rows[order]


def flatten(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after another, and their sizes."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter((i for part in parts for i in part), np.int32, int(sizes.sum())), sizes
