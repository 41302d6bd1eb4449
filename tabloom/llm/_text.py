"""Vectorised views of Arrow string columns, shared by the text operators.

Everything works on the UTF-8 bytes that Arrow holds already: no Python string is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE | U64(1), dtype=U64)
    p[0] = U64(1)
    return np.cumprod(p, dtype=U64)


POWERS = _powers(1 << 16)

#: White space of ASCII parts words; every other byte belongs to one.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Anything of ASCII but letters and digits parts terms; bytes of multi-byte characters belong to them.
NOT_TERM = np.ones(256, dtype=bool)
NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit moves every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def as_strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One plain string array; nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.string():
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the offset at which each begins (n + 1 of them)."""
    n = len(col)
    if n == 0 or col.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of about ``most`` bytes (a longer text comes alone): bounds the working memory."""
    _, offsets = utf8(col)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, col.slice(i, j - i)
        i = j


class Words:
    """Maximal runs of bytes that ``apart`` does not part: where they begin and end, in which text they are, their hashes."""

    def __init__(self, col: pa.Array, apart: np.ndarray = SPACE, lower: bool = True) -> None:
        data, offsets = utf8(pc.utf8_lower(col) if lower else col)
        n = len(data)
        inside = ~apart[data]
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        cuts = offsets[1:-1]
        before[cuts[cuts < n]] = False
        first = inside & ~before
        self.starts = np.flatnonzero(first)
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:] & ~first[1:]
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.n_docs = len(col)
        at = np.arange(n, dtype=np.int32)
        k = at - np.maximum.accumulate(np.where(first, at, 0)) if n else at
        c = (data.astype(U64) + U64(1)) * POWERS[k & 0xFFFF]
        c[~inside] = 0
        self._sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(c, out=self._sums[1:])

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A hash of each whole word, or of its first ``most`` bytes."""
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        return self._sums[ends] - self._sums[self.starts]
