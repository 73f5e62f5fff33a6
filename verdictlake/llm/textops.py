"""Vectorised text primitives shared by the corpus operators.

Everything here works on one Arrow batch in numpy: bytes are classified through a
256-entry table and words are hashed with prefix sums, so no Python loop runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEED = 0x5DEECE66D
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed in one go; bounds the working memory whatever the length of a text.
SLICE = 1 << 19

_rng = np.random.Generator(np.random.PCG64(_SEED))
_RANDOM = _rng.integers(1, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: Random value of a byte, with A-Z taken as a-z.
BYTE_VALUE = _RANDOM[_LOWER]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of words: the six ASCII white-space bytes.
SPACE = _SPACE
_NOT_ALNUM = np.zeros(256, bool)
_NOT_ALNUM[:128] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _NOT_ALNUM[_a:_b] = False
#: Separators of tokens: every ASCII byte that is no letter or digit.
NOT_ALNUM = _NOT_ALNUM

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE + 1)
        p, q = np.full(size, _BASE), np.full(size, _INV)
        p[0] = q[0] = 1
        np.cumprod(p, out=p)
        np.cumprod(q, out=q)
        if size > 4 * SLICE:
            return p, q
        _pow, _inv = p, q
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a whole string column and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all rows, and where each row's words begin.

    A word is a longest run of bytes that are no separators, inside one row.
    """
    out, where, at, total = [], [], 0, len(data)
    edges = np.zeros(total + 1, bool)
    edges[offsets] = True
    while at < total:
        end = min(total, at + SLICE)
        if end < total:  # cut where a word ends, never inside one
            closed = np.flatnonzero(separators[data[at:end]] | edges[at:end])
            if len(closed) and closed[-1] > 0:
                end = at + int(closed[-1])
            else:
                step = end
                while step < total:
                    more = np.flatnonzero(separators[data[step : step + SLICE]] | edges[step : min(total, step + SLICE)])
                    if len(more):
                        break
                    step += SLICE
                end = min(total, step + int(more[0])) if step < total else total
        part = data[at:end]
        solid = ~separators[part]
        edge = edges[at:end]
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:]
        starts = np.flatnonzero(first)
        if len(starts):
            last = solid.copy()
            last[:-1] &= ~solid[1:] | edge[1:]
            ends = np.flatnonzero(last)
            powers, inverse = _powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE_VALUE[part] * powers[: len(part)], out=sums[1:])
            h = (sums[ends + 1] - sums[starts]) * inverse[starts]
            out.append(mix(h + (ends - starts).astype(np.uint64)))
            where.append(starts + at)
        at = end
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    places = np.concatenate(where) if where else np.zeros(0, np.int64)
    return hashes, np.searchsorted(places, offsets)


_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64) * _BASE) | np.uint64(1)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words; empty when there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += words[k : k + n] * _MULTIPLIERS[k % 64]
    return mix(h)


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles of one row; with fewer words than ``width`` the whole sequence is the only one."""
    if len(words) == 0:
        return words
    if len(words) < width:
        return window_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(words, width))


#: What operators keep in a worker process from task to task: name -> what forgets it.
KEPT: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Returns memory that was freed, but that the allocators of Arrow and of the process still hold, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def lean(run, keeps: str | None = None):
    """``run`` for mapInArrow, in a worker process that lives on: what other operators keep there, all but ``keeps``, is forgotten first, and freed memory is given back at the end."""

    def task(rows):
        for name, forget in KEPT.items():
            if name != keeps:
                forget()
        try:
            yield from run(rows)
        finally:
            give_back()

    return task


def batches(batch: pa.RecordBatch, column: str, size: int = 4 << 20):
    """Slices of a batch with about ``size`` bytes of ``column`` each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, ends = 0, np.cumsum(lengths)
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to
