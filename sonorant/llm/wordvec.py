"""Vectorised word scanning of Arrow string columns.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+`` on the text.
The scan works on the UTF-8 buffer of a whole Arrow array, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash can serve as a bucket number."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if len(column) else pa.array([], pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a batch of texts.

    start, end: byte positions in ``raw``; doc: index of the text; first: per text the index of its first word
    (one more entry than texts); hash: 64-bit hash of each word's bytes.
    """

    #: Bytes hashed at once; bounds the memory of the prefix sums.
    BLOCK = 1 << 22

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.raw = _LOWER[raw] if lower else raw
        self.offsets = offsets
        inside = ~_IS_SPACE[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < len(raw))]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        """Polynomial hashes modulo 2**64 from prefix sums, block by block, then mixed; equal bytes give equal hashes."""
        out = np.zeros(len(self.start), dtype=np.uint64)
        done = 0
        while done < len(self.start):
            begin = self.start[done]
            stop = max(done + 1, int(np.searchsorted(self.end, begin + self.BLOCK, side="right")))
            piece = self.raw[begin : self.end[stop - 1]].astype(np.uint64) + np.uint64(1)
            up, down = _powers(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(piece * up[: len(piece)], out=sums[1:])
            s, e = self.start[done:stop] - begin, self.end[done:stop] - begin
            out[done:stop] = (sums[e] - sums[s]) * down[s]
            done = stop
        return mix64(out ^ (self.end - self.start).astype(np.uint64))


def words(column: pa.Array, lower: bool = False) -> Words:
    return Words(*utf8(column), lower=lower)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the runs that first delimits."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]
