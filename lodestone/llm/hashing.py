"""64-bit hashes of many stretches of a byte string at once."""

from __future__ import annotations

import numpy as np

POWER = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a number and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = np.full(n, POWER, np.uint64)
            base[0] = 1
            self.up = np.multiply.accumulate(base)
            base[1:] = pow(POWER, -1, 1 << 64)
            self.down = np.multiply.accumulate(base)
        return self.up, self.down


_powers = _Powers()


#: Bytes whose sums are taken at once; one longer stretch makes a block of its own.
BLOCK = 4 << 20


def stretch_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each ``raw[starts[i]:ends[i]]``, wherever it stands: a polynomial in its bytes, from differences of sums over
    blocks of ``raw``. Stretches are in ascending order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        part = raw[base : int(ends[stop - 1])]
        up, down = _powers.upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        a, b = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = stop
    return out
