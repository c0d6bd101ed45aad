"""Substring deduplication over words by prefix-partitioned suffix trees.

A suffix starts at every word that has a whole window (13 words) before its document's end. ``repeats`` narrows them down
to those that may recur; it brings them together by shard (a batch) and afterwards across shards. Within a shard,
suffixes are split by their leading words into groups of bounded size, a prefix being lengthened word by word while its
group is too large; each group's suffix tree, cut at the window's depth, is built from the sorted suffixes - words
compared as words, not by hash - and their common prefixes. Every internal node at full depth is a maximal class of equal
windows, and nothing else decides inside a shard. In each class all windows but those of the least document are repeats.

Edge cases: null and short texts have no window and lose nothing; very long texts are whole; a passage repeated within
one document only stays; rows that repeat an id are one document for this purpose (its windows are not smaller than
themselves); a null id is never matched; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textnum
from .repeats import ASK, FLAG, SEND, SUPER, Rolling, Spec, covered, joined, keyed, resolve, super_records, supers, window_records
from .repeats import digests as stretches

SPEC = Spec(window=13, gram=5, ordered=True)
#: Suffixes that one subtree may hold before its prefix is lengthened.
SUBTREE = 1 << 16


def _blocks(batch: pa.RecordBatch):
    """(row, word hashes, word offsets...) per document of a batch, block by block."""
    data, offsets = textnum.flat(batch.column(2))
    for i, j, part, at in textnum.blocks(data, offsets):
        starts, ends, wo = textnum.words(part, at)
        hashes = textnum.word_hashes(part, starts, ends)
        order = (textnum.grams(hashes, SPEC.gram) >> np.uint64(32)).astype(np.uint32)
        for k in range(j - i):
            a, b = wo[k], wo[k + 1]
            yield i + k, hashes[a:b], order[a : max(a, b - SPEC.gram + 1)], part, starts[a:b], ends[a:b]


def _joined_words(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A document's words joined by one blank each, and where they start and end there."""
    if not len(starts):
        return np.zeros(0, np.uint8), starts, ends
    base = int(starts[0])
    x = part[base : int(ends[-1])].copy()
    keep = ~textnum.SPACE[x]
    keep[ends[:-1] - base] = True
    x[ends[:-1] - base] = 32
    at = np.cumsum(ends - starts + 1)
    return x[keep], at - (ends - starts + 1), at - 1


def collect(batch: pa.RecordBatch, n_bins: int, known: dict[int, tuple[int, int]]) -> pa.RecordBatch | None:
    doc, mark = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    parts: dict[str, list[np.ndarray]] = {c: [] for c in SUPER[:-1]}
    for row, hashes, order, part, starts, ends in _blocks(batch):
        if (s := supers(order, SPEC)) is None:
            continue
        first, count, anchor = s
        text, a, b = _joined_words(part, starts, ends)
        whole = stretches(text.tobytes(), a[first], b[first + count + SPEC.window - 2])
        for c, v in (("anchor", Rolling(hashes).of(anchor, anchor + SPEC.gram)), ("whole", whole[0]), ("whole2", whole[1]), ("doc", np.full(len(first), doc[row])), ("mark", np.full(len(first), mark[row])), ("place", np.arange(len(first)))):
            parts[c].append(v)
    return super_records(n_bins, SPEC, {c: np.concatenate(v) for c, v in parts.items()}, known) if parts["doc"] else None


def word_ids(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each word (given as bytes one after another, and sizes): equal words, and only those, share one."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(words))])
    return array.dictionary_encode().indices.to_numpy().astype(np.int64)


def partition(ids: np.ndarray, at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """(suffixes, words they have in common): groups of at most ``most`` suffixes by prefixes of variable length, small
    neighbours together. A group that agrees in a whole window is one whatever its size."""
    todo = [(np.arange(len(at)), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) <= most or depth == SPEC.window:
            yield group, depth
            continue
        key = ids[at[group] + depth]
        order = np.argsort(key, kind="stable")
        group, key = group[order], key[order]
        edges = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        a = 0
        while a < len(edges) - 1:
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + most, "right")) - 1)
            todo.append((group[edges[a] : edges[b]], depth + (b == a + 1)))
            a = b


def subtree(ids: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the leaves of one group's tree in order, and how many words (at most a window) each has in common
    with the leaf before. All agree in their first ``depth`` words."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    step, keys = max(1, 63 // bits), []
    for a in range(depth, SPEC.window, step):  # several words in one sort key
        k = np.zeros(len(at), np.int64)
        for w in range(a, min(a + step, SPEC.window)):
            k = k << bits | ids[at + w]
        keys.append(k)
    order = np.lexsort(keys[::-1]) if keys else np.arange(len(at))
    sorted_, same, common = at[order], np.ones(max(0, len(at) - 1), bool), np.full(len(at), depth)
    for w in range(depth, SPEC.window):
        same = same & (ids[sorted_[1:] + w] == ids[sorted_[:-1] + w])
        common[1:] += same
    common[:1] = 0
    return order, common


def deep_nodes(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The internal node at full depth (or the leaf) that each of the suffixes ``at`` of the stream of words hangs from."""
    out, nodes = np.empty(len(at), np.int64), 0
    for group, depth in partition(ids, at, SUBTREE):
        order, common = subtree(ids, at[group], depth)
        out[group[order]] = nodes + np.cumsum(common < SPEC.window)
        nodes += len(group) + 1
    return out


def open_windows(batch: pa.RecordBatch, n_bins: int, shards: Iterator[int]) -> Iterator[pa.RecordBatch | None]:
    doc, mark = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    place, state = joined(batch.column(3), "place"), joined(batch.column(4), "state")
    names, more = ["doc", "mark", "place", "state", "at"], ["doc", "mark", "place", "count"]
    parts: dict[str, list[np.ndarray]] = {c: [np.zeros(0, np.int64)] for c in names}
    runs: dict[str, list[np.ndarray]] = {c: [np.zeros(0, np.int64)] for c in more}
    text, begin, end, size, n_words = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    for row, _, order, part, starts, ends in _blocks(batch):
        if (s := supers(order, SPEC)) is None:
            continue
        first, count, _ = s
        p, t = place[row], state[row]
        f = p[t & FLAG > 0]
        for c, v in zip(more, (np.full(len(f), doc[row]), np.full(len(f), mark[row]), first[f], count[f])):
            runs[c].append(v)
        o = np.flatnonzero(t & (ASK | SEND))
        if len(o):
            n = count[p[o]]
            at = np.repeat(first[p[o]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            for c, v in zip(names, (np.full(len(at), doc[row]), np.full(len(at), mark[row]), at, np.repeat(t[o], n), at + n_words)):
                parts[c].append(v)
            x, a, b = _joined_words(part, starts, ends)
            text.append(x)
            begin.append(a + size)
            end.append(b + size)
            size, n_words = size + len(x), n_words + len(a)
    x, a, b = np.concatenate(text), np.concatenate(begin), np.concatenate(end)
    r = {c: np.concatenate(v) for c, v in parts.items()}
    at = r.pop("at")
    classes = deep_nodes(word_ids(x[~textnum.SPACE[x]], b - a), at)
    raw = x.tobytes()
    yield window_records(n_bins, SPEC, next(shards), classes, r, {c: np.concatenate(v) for c, v in runs.items()}, lambda i: stretches(raw, a[at[i]], b[at[i] + SPEC.window - 1]))


def _results(batch: pa.RecordBatch):
    """Per row: data, word starts, ends and which words go."""
    place, count = joined(batch.column(3), "place"), joined(batch.column(4), "count")
    data, offsets = textnum.flat(batch.column(2))
    for i, j, part, at in textnum.blocks(data, offsets):
        starts, ends, wo = textnum.words(part, at)
        for k in range(j - i):
            s, e = starts[wo[k] : wo[k + 1]], ends[wo[k] : wo[k + 1]]
            gone = covered(len(s), SPEC.window, place[i + k], count[i + k]) if len(place[i + k]) else np.zeros(len(s), bool)
            yield i + k, part, s, e, gone


def kept_text(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    raw = part.tobytes() if len(starts) else b""
    return b" ".join([raw[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist())])


def _run(df: DataFrame, key: str, text: str, finish, schema: str) -> DataFrame:
    return resolve(keyed(df, key, text), SPEC, collect, open_windows, finish, schema)


def dedupe(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, text: every text without its repeated words, the rest joined by one blank."""

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, out = [], [], []
        for _, part, s, e, gone in _results(batch):
            base = int(s[0]) if len(s) else 0
            n.append(len(s))
            removed.append(int(gone.sum()))
            out.append(kept_text(part[base : e[-1]] if len(s) else part[:0], s - base, e - base, gone))
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return _run(df, key, text, finish, "doc_id long, n_words long, n_removed long, text string")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, out = [], [], []
        for _, part, s, e, gone in _results(batch):
            base = int(s[0]) if len(s) else 0
            n.append(len(s))
            removed.append(int(gone.sum()))
            out.append(hashlib.sha256(kept_text(part[base : e[-1]] if len(s) else part[:0], s - base, e - base, gone)).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _run(df, key, text, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
