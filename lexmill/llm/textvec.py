"""Vectorised words and shingles of Arrow string batches.

Words are maximal runs of bytes other than space and \\t\\n\\v\\f\\r, with A-Z lower-cased unless asked otherwise. A word's 64-bit hash is a
polynomial over per-byte random values modulo 2**64, taken from one running sum over the whole buffer, so no Python code
runs per word or per byte.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE_FOLD = _TABLE.copy()
_TABLE_FOLD[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text handled at once; longer texts are cut at white space.
PIECE = 1 << 20
_powers = {"n": 0}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 2 * PIECE)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(31))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offs, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    off = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, off - off[0]


def slices(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, sub-array) with about ``limit`` bytes each, so that memory does not follow the batch size."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    mark = np.cumsum(size) // limit
    cuts = np.flatnonzero(np.diff(mark)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
        yield a, texts.slice(a, b - a)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task, which gives what Arrow and C keep of freed memory back to the system when its partition ends: a worker process goes on
    to other tasks and would hold the most that any of them took."""

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return run


@dataclass
class Words:
    """All words of some texts: byte spans, hashes, and the first word of each text (one more at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.first) - 1


def _spans(data: np.ndarray, off: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~space[data]
    at = off[(off > 0) & (off < len(data))]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[at] = inside[at]
    end = inside
    keep = end[at - 1].copy()
    end = end.copy()
    end[:-1] &= ~inside[1:]
    end[at - 1] = keep
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(texts: pa.Array, space: np.ndarray = SPACE, fold: bool = True) -> Words:
    """The words of ``texts`` (see ``slices`` for bounding memory).

    ``space`` tells which bytes separate words; without ``fold`` A-Z keep their case.
    """
    data, off = buffer_of(texts)
    table = _TABLE_FOLD if fold else _TABLE
    starts, ends, hashes = [], [], []
    a = 0
    while a < len(data):
        b = min(len(data), a + PIECE)
        if b < len(data):
            gap = np.flatnonzero(space[data[b : b + PIECE]])
            while not len(gap) and b < len(data):
                b += PIECE
                gap = np.flatnonzero(space[data[b : b + PIECE]])
            b = min(len(data), b + (int(gap[0]) if len(gap) else 0))
        part = data[a:b]
        lo, hi = np.searchsorted(off, [a, b])
        s, e = _spans(part, off[lo:hi] - a, space)
        up, down = _power(len(part) + 1)
        run = np.empty(len(part) + 1, dtype=np.uint64)
        run[0] = 0
        np.cumsum(table[part] * up[: len(part)], out=run[1:])
        hashes.append(mix((run[e] - run[s]) * down[s]))
        starts.append(s + a)
        ends.append(e + a)
        a = b
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, dtype=t)
    start = join(starts, np.int64)
    return Words(data, start, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(start, off))


def grams(w: Words, k: int) -> np.ndarray:
    """Hash of the k words from each word on (k - 1 fewer values than words; may cross texts, see ``gram_bounds``)."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = w.hash[:n].copy()
    for j in range(1, k):
        acc ^= acc >> np.uint64(29)
        acc *= _MIX[2]
        acc += w.hash[j : j + n]
    return mix(acc)


def shingle_sets(w: Words, k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct k-word shingles as 64-bit hashes.

    A text of fewer than k words has one shingle, its whole sequence; one without words has none.
    """
    g = grams(w, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            s = np.sort(g[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        elif n:
            acc = np.uint64(n)
            for h in w.hash[a:b]:
                acc = mix(np.array([acc], dtype=np.uint64) * _MIX[3] + h)[0]
            out.append(np.array([acc], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
