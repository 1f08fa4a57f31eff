"""Words of whole Arrow text columns, split and hashed with numpy alone.

A word is a maximal run of bytes other than space and \\t..\\r, or than those a caller names; A-Z are lower-cased before
hashing.
Null texts count as empty. Work goes through slices of half a MB (or one longer text), so memory stays bounded for any batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
HASHED_BYTES = 256 << 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE = _BYTE[LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of the documents first..first+n-1 of a column; bounds has n+1 word positions."""

    first: int
    data: np.ndarray  # bytes of the slice, as they are
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray


def text_slices(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, n+1 offsets into them) for runs of whole texts of about `size` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        to = min(to, len(column))
        yield at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def powers(n: int, step: np.uint64 = _STEP) -> np.ndarray:
    p = np.full(max(n, 1), step, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def words(column: pa.Array, slice_bytes: int | None = None, between: np.ndarray = _SPACE) -> Iterator[Words]:
    """between: for each byte, whether it stands between words."""
    for first, data, off in text_slices(column, slice_bytes or SLICE_BYTES):
        solid = ~between[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = solid[:-1]
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        yield Words(first, data, start, end, np.searchsorted(start, off), _hashes(data, solid, start, end))


def _hashes(data: np.ndarray, solid: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, made for runs of words of about HASHED_BYTES at a time."""
    out = np.zeros(len(start), np.uint64)
    cuts = np.unique(np.concatenate((np.searchsorted(start, np.arange(0, len(data), HASHED_BYTES)), [0, len(start)])))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        piece = slice(start[i], end[j - 1])
        size = end[i:j] - start[i:j]
        at = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(at, size)
        value = _BYTE[data[piece][solid[piece]]] * powers(int(size.max()))[inside]
        out[i:j] = mix(np.add.reduceat(value, at) + size.astype(np.uint64) * _STEP)
    return out


def word_strings(w: Words, which: np.ndarray) -> list[str]:
    """The lower-cased words at the given positions."""
    low = LOWER[w.data].tobytes()
    return [low[a:b].decode("utf-8", "replace") for a, b in zip(w.start[which].tolist(), w.end[which].tolist(), strict=True)]
