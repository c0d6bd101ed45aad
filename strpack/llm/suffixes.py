"""Byte-level deduplication by suffix arrays.

A byte goes when a 200-byte string that covers it also starts anywhere else. ``repeats`` narrows the corpus down to the
stretches where that is still open; each shard (a block of a batch's open stretches) then gets a suffix array by
Larsson-Sadakane refinement in numpy - first by seven bytes, then doubling the sorted depth among unsorted groups only -
and Kasai's common prefixes over it. Neighbours in the array with 200 bytes in common are the shard's classes of equal
strings, and nothing else decides inside a shard. Every class sends one record with the digest of its string; the shards'
sorted runs are merged by binary search, and what another shard holds too is a repeat.

Edge cases: null and short texts (under 200 bytes) lose nothing; very long texts are whole, their open stretches making up
one or more shards; overlapping occurrences count; repeated rows are occurrences of each other; a null id is never
matched; an empty table gives an empty result; extra columns are not read; strings are judged on the input, not on what
is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textnum
from .repeats import ASK, FLAG, SEND, SUPER, U, Rolling, Spec, covered, joined, keyed, resolve, super_records, supers, window_records
from .repeats import digests as stretches

SPEC = Spec(window=200, gram=128, ordered=False)
#: Bytes of open stretches in one suffix array.
SHARD = 4 << 20


def gram_order(x: np.ndarray) -> np.ndarray:
    """32-bit hash of the 128 bytes at each place, by doubling."""
    h = (x.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    step = 1
    while step < SPEC.gram:
        h = h[:-step] * np.uint32(0x85EBCA6B) + h[step:] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(13)
        step *= 2
    return h


def suffix_array(x: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of the suffixes of x, each running to its own stretch's end (ends[i]) and compared by at most
    ``depth`` symbols; suffixes that agree so far share a rank."""
    n = len(x)
    at = np.arange(n)
    key = np.zeros(n, U)
    for k in range(7):  # seven symbols of nine bits; past the end is 0, below every byte
        s = np.zeros(n, U)
        s[: n - k] = x[k:].astype(U) + U(1) if k < n else 0
        s[at + k >= ends] = 0
        key = key << U(9) | s
    sa = np.argsort(key, kind="stable")
    sorted_ = key[sa]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 7
    while h < depth:
        step = min(h, depth - h)  # the last step overlaps, so that the depth is met exactly
        size = np.diff(np.append(np.flatnonzero(new), n))
        open_ = np.flatnonzero(np.repeat(size, size) > 1)  # places in unsorted groups
        if not len(open_):
            break
        i = sa[open_]
        beyond = i + step
        second = np.where(beyond < ends[i], rank[np.minimum(beyond, n - 1)], -1)
        first = rank[i]
        order = np.lexsort((second, first))
        i, first, second = i[order], first[order], second[order]
        sa[open_] = i
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        new[open_] = fresh
        rank = rank.copy()
        rank[i] = np.maximum.accumulate(np.where(fresh, open_, 0))
        h += step
    return sa, rank


def kasai(x: np.ndarray, ends: np.ndarray, sa: np.ndarray, wanted: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix (at most ``limit``) of each wanted place of the suffix array with the place before it. Kasai's
    order: suffixes by text position, each starting from its predecessor's length less one; 64 bytes are compared at a
    time."""
    out = np.zeros(len(sa), np.int64)
    places = np.flatnonzero(wanted)
    places = places[places > 0]
    places = places[np.argsort(sa[places], kind="stable")]
    raw, h, last = x.tobytes(), 0, -2
    for p, i, j in zip(places.tolist(), sa[places].tolist(), sa[places - 1].tolist()):
        h = h - 1 if i == last + 1 and h > 0 else 0
        top = min(limit, int(ends[i]) - i, int(ends[j]) - j)
        while h < top:
            m = min(64, top - h)
            if raw[i + h : i + h + m] == raw[j + h : j + h + m]:
                h += m
                continue
            while raw[i + h] == raw[j + h]:
                h += 1
            break
        out[p], last = h, i
    return out


def string_classes(x: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Class of equality of the ``length``-byte strings at ``starts`` (each inside its stretch)."""
    sa, rank = suffix_array(x, ends, length)
    # Places whose predecessor has the same rank agree to the full depth; the common prefixes confirm it.
    tied = np.zeros(len(sa), bool)
    tied[1:] = rank[sa[1:]] == rank[sa[:-1]]
    whole = np.zeros(len(x), bool)
    whole[starts] = True
    tied &= whole[sa]
    same = kasai(x, ends, sa, tied, length) >= length
    classes = np.empty(len(sa), np.int64)
    classes[sa] = np.cumsum(~same)
    return classes[starts]


def collect(batch: pa.RecordBatch, n_bins: int, known: dict[int, tuple[int, int]]) -> pa.RecordBatch | None:
    doc, mark = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    data, offsets = textnum.flat(batch.column(2))
    parts: dict[str, list[np.ndarray]] = {c: [] for c in SUPER[:-1]}
    for row in np.flatnonzero(np.diff(offsets) >= SPEC.window):
        x = data[offsets[row] : offsets[row + 1]]
        first, count, anchor = supers(gram_order(x), SPEC)
        h, n = Rolling(x.astype(U) + U(1)), len(first)
        whole = stretches(x.tobytes(), first, first + count + SPEC.window - 1)
        for c, v in (("anchor", h.of(anchor, anchor + SPEC.gram)), ("whole", whole[0]), ("whole2", whole[1]), ("doc", np.full(n, doc[row])), ("mark", np.full(n, mark[row])), ("place", np.arange(n))):
            parts[c].append(v)
    return super_records(n_bins, SPEC, {c: np.concatenate(v) for c, v in parts.items()}, known) if parts["doc"] else None


def open_windows(batch: pa.RecordBatch, n_bins: int, shards: Iterator[int]) -> Iterator[pa.RecordBatch | None]:
    doc, mark = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    data, offsets = textnum.flat(batch.column(2))
    place, state = joined(batch.column(3), "place"), joined(batch.column(4), "state")
    names, more = ["doc", "mark", "place", "state", "start"], ["doc", "mark", "place", "count"]
    runs: dict[str, list[np.ndarray]] = {c: [np.zeros(0, np.int64)] for c in more}
    parts: dict[str, list[np.ndarray]] = {c: [np.zeros(0, np.int64)] for c in names}
    text: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    size = 0

    def shard() -> pa.RecordBatch | None:
        """The records of the stretches gathered so far."""
        nonlocal size
        r = {c: np.concatenate(v) for c, v in parts.items()}
        settled = {c: np.concatenate(v) for c, v in runs.items()}
        x, start = np.concatenate(text) if text else np.zeros(0, np.uint8), r.pop("start")
        classes = string_classes(x, np.concatenate(ends), start, SPEC.window) if len(start) else start
        raw = x.tobytes()
        for v in (*parts.values(), *runs.values()):
            del v[1:]
        text.clear(), ends.clear()
        size = 0
        return window_records(n_bins, SPEC, next(shards), classes, r, settled, lambda at: stretches(raw, start[at], start[at] + SPEC.window))

    for row in range(batch.num_rows):
        x = data[offsets[row] : offsets[row + 1]]
        if len(x) < SPEC.window:
            continue
        first, count, _ = supers(gram_order(x), SPEC)
        p, t = place[row], state[row]
        f = p[t & FLAG > 0]
        for c, v in zip(more, (np.full(len(f), doc[row]), np.full(len(f), mark[row]), first[f], count[f])):
            runs[c].append(v)
        o = np.flatnonzero(t & (ASK | SEND))
        if not len(o):
            continue
        o = o[np.argsort(p[o])]
        n = count[p[o]]
        at = np.repeat(first[p[o]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        for a, b in zip([0, *cuts], [*cuts, len(at)]):  # runs of consecutive windows are one stretch of text
            piece = x[at[a] : at[b - 1] + SPEC.window]
            text.append(piece)
            parts["start"].append(size + np.arange(b - a))
            size += len(piece)
            ends.append(np.full(len(piece), size))
        for c, v in zip(names, (np.full(len(at), doc[row]), np.full(len(at), mark[row]), at, np.repeat(t[o], n))):
            parts[c].append(v)
        if size >= SHARD:
            yield shard()
    yield shard()


def _run(df: DataFrame, key: str, text: str, finish, schema: str) -> DataFrame:
    return resolve(keyed(df, key, text), SPEC, collect, open_windows, finish, schema)


def _results(batch: pa.RecordBatch):
    place, count = joined(batch.column(3), "place"), joined(batch.column(4), "count")
    data, offsets = textnum.flat(batch.column(2))
    for i in range(batch.num_rows):
        x = data[offsets[i] : offsets[i + 1]]
        yield x, covered(len(x), SPEC.window, place[i], count[i]) if len(place[i]) else np.zeros(len(x), bool)


def dedupe(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, kept BINARY: a cut may fall inside a character, so what remains is bytes."""

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(len(x), int(gone.sum()), x[~gone].tobytes()) for x, gone in _results(batch)]
        return pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))]], names=["doc_id", "n_bytes", "n_removed", "kept"])

    return _run(df, key, text, finish, "doc_id long, n_bytes long, n_removed long, kept binary")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x, gone in _results(batch):
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rows.append((len(x), int(gone.sum()), spans, hashlib.sha256(x[~gone].tobytes()).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _run(df, key, text, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
