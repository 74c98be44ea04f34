"""Word and shingle hashes of many texts at once (numpy, inside tasks).

Words are maximal runs of bytes other than space and 0x09-0x0D, A-Z in lower
case.  A word's hash is a polynomial over random 64-bit byte values, computed
for a block of text by one running sum, so the cost is a few array operations
per byte whatever the number of words.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = _SPACE.tobytes()
_FOLDED_BYTE = _BYTE[_FOLD]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@cache
def _block_powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of both factors for a block and the word that reaches into it."""
    n = BLOCK + (1 << 12)
    return _powers(_P, n), _powers(_P_INV, n)


def mapped(raw: np.ndarray, table: bytes) -> np.ndarray:
    """``raw`` with every byte replaced by its place in ``table``."""
    return np.frombuffer(raw.tobytes().translate(table), np.uint8)


class Words:
    """Words of a byte string: ``start``, ``end`` (byte places) and ``hash``."""

    def __init__(self, raw: np.ndarray):
        gap = mapped(raw, _GAP).view(np.int8)
        edge = np.flatnonzero(np.diff(gap, prepend=np.int8(1), append=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = np.empty(len(self.start), np.uint64)
        if not len(self.start):
            return
        block = (self.end - 1) // BLOCK
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = self.start[a], self.end[b - 1]
            n = int(hi - lo)
            running = np.empty(n + 1, np.uint64)
            running[0] = 0
            powers, back = _block_powers() if n <= BLOCK + (1 << 12) else (_powers(_P, n), _powers(_P_INV, n))
            np.cumsum(_FOLDED_BYTE.take(raw[lo:hi]) * powers[:n], out=running[1:])
            s, e = self.start[a:b] - lo, self.end[a:b] - lo
            self.hash[a:b] = mix((running[e] - running[s]) * back[s] + (e - s).astype(np.uint64))


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` consecutive words, one for each place they can start."""
    m = len(hashes) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for k in range(n):
        out = mix(out * _P + hashes[k : k + len(out)] + np.uint64(k + 1))
    return out


def utf8_parts(column: pa.Array, limit: int = 2 << 20):
    """Texts of an Arrow string column as ``(first row, bytes, offsets)``,
    about ``limit`` bytes at a time and whole texts always; null is empty.  A
    line end stands after each text: text i is ``offsets[i]:offsets[i + 1] - 1``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        texts = [data[a:b] for a, b in zip(at[row:stop].tolist(), at[row + 1 : stop + 1].tolist(), strict=True)]
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        yield row, raw, at[row : stop + 1] - at[row] + np.arange(stop - row + 1)
        row = stop


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int):
    """For each text of a part: the sorted distinct hashes of its n-word
    shingles (fewer words: of the whole sequence; no words: empty)."""
    words = Words(raw)
    bounds = np.searchsorted(words.start, offsets)
    whole = combine(words.hash, n)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(whole[a : b - n + 1]) if b - a >= n else _set(words.hash[a:b], n)


def _set(hashes: np.ndarray, n: int) -> np.ndarray:
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(combine(hashes, min(n, len(hashes))))
