"""Vectorised text primitives shared by the operators of this subpackage (numpy over UTF-8 buffers).

Everything here works on one flat byte buffer plus document offsets, so that the cost per byte is a few numpy passes
and memory stays proportional to the block that the caller hands in (see ``blocks``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The white space of every word rule here: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK_BYTES = 2 << 20
U = np.uint64


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``most`` bytes: first document, end, bytes, offsets. A longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of every document, and each document's offsets into them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    ink = ~SPACE[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = ink[cuts]
    last[cuts - 1] = ink[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS = np.ones(1, U)
_P = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, 4096) - 1, _P, U)]))
    return _POWERS


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes, in runs of words of about BLOCK_BYTES so that temporaries stay small."""
    out, i = np.empty(len(starts), U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        size = e - s
        table = _powers(int(size.max()))
        at = np.arange(int(e[-1]), dtype=np.int64)
        gap = np.zeros(int(e[-1]), bool)
        edge = np.zeros(int(e[-1]), np.int64)
        edge[s] = s
        np.maximum.accumulate(edge, out=edge)
        at -= edge
        if len(s) > 1:
            gap = SPACE[data[starts[i] : ends[j - 1]]]
        at[at >= len(table)] = 0
        with np.errstate(over="ignore"):
            value = (data[starts[i] : ends[j - 1]].astype(U) + U(1)) * table[at]
            value[gap] = 0
            out[i:j] = np.add.reduceat(value, s) + size.astype(U) * U(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values (length: len - n + 1); the caller drops those that cross a document's end."""
    if len(hashes) < n:
        return np.zeros(0, U)
    size = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        g = hashes[:size].copy()
        for k in range(1, n):
            g *= U(0xD1342543DE82EF95)
            g += hashes[k : k + size]
    return mix(g)


def sliding(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over every w consecutive values, by doubling."""
    step, y = 1, x
    while step * 2 <= w:
        y = op(y[:-step], y[step:])
        step *= 2
    return op(y[: len(x) - w + 1], y[w - step : w - step + len(x) - w + 1]) if step < w else y


def anchors(order: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least value of some w consecutive ones (ties: all of them). Equal windows have equal
    values, hence equal anchors at equal places; about 2 / (w + 1) of the positions are anchors."""
    if len(order) < w:
        return np.zeros(0, np.int64)
    least = sliding(order, w)
    pad = np.zeros(w - 1, order.dtype)
    top = sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    return np.flatnonzero(top == order)
