"""Exact repeats at corpus scale: the exchange that substring and suffix-array deduplication share.

A *window* is a fixed number of consecutive symbols (words or bytes). Comparing every window of a corpus would move far
more than the corpus, so windows meet in two steps, both exact:

1. *Super-windows.* Every window has an anchor, the least short gram inside it, and equal windows have equal anchors at
   equal places. Consecutive windows with one anchor form a super-window, identified by a digest of all its symbols.
   One record for each super-window (anchor, digest, document) is exchanged. If the whole super-window recurs, all its
   windows are settled at once; if not even its anchor recurs, none of them does. The anchor's hash only brings records
   together; what decides is the digest.
2. *Open windows.* What remains - the anchor recurs in other company, typically at the edges of a shared passage - is
   settled window by window. A shard (the open stretches of a batch) finds its own classes of equal windows from their
   symbols, by the operator's suffix array or suffix trees; each class sends one record, and classes of different shards
   are merged by binary search among the sorted digests of their windows. Merging never looks inside a shard.

Digests are BLAKE2b over the symbols themselves. Windows carry 128 bits: among 10^13 windows two different ones agree with
a probability of 10^-13. Super-windows are only told apart among those of one anchor, and 96 bits do for that: with 10^13 of
them and 10^7 to an anchor the probability is 10^-9.

Every batch of documents first settles what it can by itself and sends one record for each distinct key; of an anchor in
many different super-windows, a task shows no further ones once it has shown more than ``CROWD``: they are open. So the group of one key
holds about one small record per batch however often it occurs: a passage in a third of all rows is no hot group.
Answers travel back as lists per document, and meet the texts by document key.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import bins, by_batch, release

U = np.uint64
FLAG, ASK, SEND, SHOWN = 1, 2, 4, 128  # settled as repeated; open: wants an answer; its windows may settle others'; to be settled among batches
#: Distinct super-windows of one anchor in one batch beyond which they skip step 1's comparison and are open.
CROWD = 16
#: Crowded anchors that a task remembers.
KNOWN = 1 << 17


@dataclass(frozen=True)
class Spec:
    """window and gram: symbols in a window and in the grams anchors are chosen from. ordered: only an occurrence in a
    document with a smaller id counts; otherwise any other occurrence does."""

    window: int
    gram: int
    ordered: bool


_INVERSE = pow(textnum._P, -1, 1 << 64)
_INVERSES = np.ones(1, U)


def inverses(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        with np.errstate(over="ignore"):
            _INVERSES = np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, 4096) - 1, _INVERSE, U)]))
    return _INVERSES


class Rolling:
    """Hash of any stretch of symbols, the same wherever it stands."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.inverse = inverses(n + 1)
        with np.errstate(over="ignore"):
            self.prefix = np.concatenate([np.zeros(1, U), np.cumsum(values * textnum._powers(n + 1)[:n], dtype=U)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return textnum.mix((self.prefix[b] - self.prefix[a]) * self.inverse[a])


def supers(order: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """First window, number of windows and anchor place of each super-window of one document, or None if it is shorter
    than a window. order: a 32-bit hash of the gram at each place."""
    w = spec.window - spec.gram + 1
    n = len(order) - w + 1
    if n <= 0:
        return None
    least, places = textnum.sliding(order, w), textnum.anchors(order, w)
    at = np.searchsorted(places, np.arange(n))
    anchor = places[at]
    wrong = np.flatnonzero(order[anchor] != least)  # the leftmost place in the window that holds its least value
    while len(wrong):
        at[wrong] += 1
        anchor[wrong] = places[at[wrong]]
        wrong = wrong[order[anchor[wrong]] != least[wrong]]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return first, np.diff(np.append(first, n)), anchor[first]


#: anchor: what tells the keys of one bin apart. whole, whole2 and key, key2: the halves of a digest.
KINDS = {"anchor": np.uint32, "whole": U, "whole2": np.uint32, "key": U, "key2": U, "doc": np.int64, "mark": np.int32, "shard": np.int64, "place": np.int32, "count": np.int32, "state": np.uint8}
SUPER = ["anchor", "whole", "whole2", "doc", "mark", "place", "state"]
WINDOW = ["key", "key2", "shard", "doc", "mark", "place", "count", "state"]


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of the digest of each stretch of bytes."""
    h = blake2b
    out = b"".join([h(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    both = np.frombuffer(out, U).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def rows(n_bins: int, key: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """Records grouped by bin (key mod n_bins): one row of raw columns for each bin."""
    if not len(key):
        return None
    bin_ = (key % U(n_bins)).astype(np.int32)
    order = np.argsort(bin_, kind="stable")
    ids, at = np.unique(bin_[order], return_index=True)
    edges = np.append(at, len(order))
    raw = [[c[order[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:])] for c in (v.astype(KINDS[k]) for k, v in columns.items())]
    return pa.record_batch([pa.array(ids, pa.int32()), *[pa.array(x, pa.binary()) for x in raw]], names=["bin", *columns])


def read(table: pa.Table | pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(table.column(c).to_pylist()), KINDS[c]) for c in names}


def answers(doc: np.ndarray, mark: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows (doc, mark, raw columns), one for each document."""
    order = np.lexsort((mark, doc))
    doc, mark = doc[order], mark[order]
    at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])) if len(doc) else np.zeros(0, np.int64)
    edges = np.append(at, len(doc))
    raw = [pa.array([c[order[a:b]].astype(KINDS[k]).tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()) for k, c in columns.items()]
    return pa.record_batch([pa.array(doc[at], pa.int64()), pa.array(mark[at], pa.int32()), *raw], names=["doc", "mark", *columns])


def _compare(r: dict[str, np.ndarray], ordered: bool, crowd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state, hidden, crowded) of super-window records, as far as these records alone show. hidden: equal records
    already tell the others everything. crowd: 0 where no anchor counts as crowded."""
    n = len(r["anchor"])
    pair = np.lexsort((r["doc"], r["whole2"], r["whole"], r["anchor"]))
    a, w, x, d = (r[c][pair] for c in ("anchor", "whole", "whole2", "doc"))
    new_a = np.concatenate([[True], a[1:] != a[:-1]])
    new_w = new_a | np.concatenate([[True], (w[1:] != w[:-1]) | (x[1:] != x[:-1])])
    aid, wid, head_a, head_w = np.cumsum(new_a) - 1, np.cumsum(new_w) - 1, np.flatnonzero(new_a), np.flatnonzero(new_w)
    wholes = np.add.reduceat(new_w.astype(np.int64), head_a)[aid]
    if ordered:
        low = np.minimum.reduceat(d, head_a)[aid]
        flag = d > d[head_w][wid]
        ask, hide = ~flag & (d > low), flag
        keep = d == low
    else:
        flag = np.diff(np.append(head_w, n))[wid] > 1
        ask, hide = ~flag & (np.diff(np.append(head_a, n))[aid] > 1), ~new_w
        keep = np.zeros(n, bool)
    send = new_w & (wholes > 1)
    crowded = (wholes > crowd) & bool(crowd)
    # Of a crowded anchor two different super-windows stay in view, and the least document's.
    hide = hide | (crowded & (wid - wid[head_a][aid] > 1) & ~keep)
    state, hidden, crowds = np.empty(n, np.uint8), np.empty(n, bool), np.empty(n, bool)
    state[pair], hidden[pair], crowds[pair] = flag * FLAG + ask * ASK + send * SEND, hide, crowded
    return state, hidden, crowds


def super_records(n_bins: int, spec: Spec, r: dict[str, np.ndarray], known: dict[int, tuple[int, int]]) -> pa.RecordBatch | None:
    """One batch's records (anchor, whole, whole2, doc, mark, place) for the exchange. What is settled here travels along
    in a bin of its document's, so that answers come from one place only. known: of anchors in several super-windows, how
    many this task has shown and the least document among them (bounded; forgetting one only costs records)."""
    if not len(r["anchor"]):
        return None
    anchor = r["anchor"]
    found, hidden, crowded = _compare(r, spec.ordered, CROWD)
    before = np.zeros(len(anchor), bool)
    if names := [a for a, (n, _) in known.items() if n > CROWD]:
        before = np.isin(anchor, np.array(names, U))
        for k in np.flatnonzero(before & ~hidden).tolist():
            hidden[k] = not (spec.ordered and r["doc"][k] < known[int(anchor[k])][1])
        crowded = crowded | before
    state = found & FLAG
    state |= np.where(crowded & (state == 0), ASK | SEND, 0).astype(np.uint8)
    state |= np.where(crowded & (found & SEND > 0), SEND, 0).astype(np.uint8)
    state |= np.where(before & (state == FLAG), SEND, 0).astype(np.uint8)
    more = np.flatnonzero((found & SEND > 0) | before & ~hidden)
    for a, d in zip(anchor[more].tolist(), r["doc"][more].tolist()):
        n, least = known.get(a, (0, d))
        known[a] = n + 1, min(least, d)
    if len(known) > KNOWN:
        known.clear()
    keep = ~hidden | (state > 0)
    key = np.where(hidden, textnum.mix(r["doc"].astype(U)), anchor)
    r = r | {"anchor": anchor >> U(32), "state": state | np.where(hidden, 0, SHOWN).astype(np.uint8)}
    return rows(n_bins, key[keep], {c: r[c][keep] for c in SUPER})


def settled_supers(table: pa.Table, ordered: bool) -> pa.Table:
    """Step 1 for one bin: for each document the places and states of the super-windows that are flagged or open."""
    r = read(table, SUPER)
    state, shown = r["state"] & ~np.uint8(SHOWN), r["state"] >= SHOWN
    if shown.any():
        state[shown] |= _compare({c: v[shown] for c, v in r.items()}, ordered, 0)[0]
    state = np.where(state & FLAG, state & ~np.uint8(ASK), state)
    keep = state > 0
    return pa.Table.from_batches([answers(r["doc"][keep], r["mark"][keep], place=r["place"][keep], state=state[keep])])


def settle_shard(classes: np.ndarray, doc: np.ndarray, ordered: bool) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, hidden) of a shard's open windows, whose equality classes are known. hidden: another window of the
    class already stands for it."""
    order = np.lexsort((doc, classes))
    c, d = classes[order], doc[order]
    new = np.concatenate([[True], c[1:] != c[:-1]])
    head = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    repeated, hidden = np.empty(len(c), bool), np.empty(len(c), bool)
    repeated[order] = d > d[head][of] if ordered else np.diff(np.append(head, len(c)))[of] > 1
    hidden[order] = repeated[order] if ordered else ~new
    return repeated, hidden


def merge_shards(r: dict[str, np.ndarray], ordered: bool) -> np.ndarray:
    """Which records' windows recur in another shard (ordered: in a smaller document of another shard). Every shard's
    digests are a sorted run; a record's are looked up in the merged run by binary search."""
    order = np.lexsort((r["shard"], r["doc"], r["key2"], r["key"]))
    key, two, doc, shard = (r[c][order] for c in ("key", "key2", "doc", "shard"))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (two[1:] != two[:-1])])
    head = np.flatnonzero(new)
    of = np.searchsorted(head, np.arange(len(key)), "right") - 1
    size = np.diff(np.append(head, len(key)))
    out = np.zeros(len(key), bool)
    if not ordered:
        low, high = np.minimum.reduceat(shard, head), np.maximum.reduceat(shard, head)
        out[order] = (low != high)[of]
        return out
    # A record's windows recur if a record of another shard has a smaller document: the first in order does, unless it
    # is of the same shard, and then the first of any other shard counts.
    first = shard[head]
    other = np.where(shard != first[of], doc, np.iinfo(np.int64).max)
    second = np.minimum.reduceat(other, head)
    least = np.where(shard == first[of], second[of], doc[head][of])
    out[order] = (doc > least) & (size[of] > 1)
    return out


def window_records(n_bins: int, spec: Spec, shard: int, classes: np.ndarray, r: dict[str, np.ndarray], runs: dict[str, np.ndarray], digest: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    """One shard's open windows (doc, mark, place, state) after its own comparison, with the digests of those shown, and
    the runs of windows that step 1 settled (doc, mark, place, count), which travel along."""
    repeated, hidden = settle_shard(classes, r["doc"], spec.ordered) if len(classes) else (np.zeros(0, bool), np.zeros(0, bool))
    flag = repeated & (r["state"] & ASK > 0)
    keep = np.flatnonzero(~hidden | flag)
    flag, hidden = flag[keep], hidden[keep]
    r = {k: v[keep] for k, v in r.items()}
    r["count"] = np.ones(len(keep), np.int32)
    shown = np.flatnonzero(~hidden)
    # In ordered matters a class shows all windows of its least document; they have one digest.
    r["key"], r["key2"] = np.zeros(len(keep), U), np.zeros(len(keep), U)
    heads, back = np.unique(classes[keep[shown]], return_index=True, return_inverse=True)[1:]
    one, two = digest(keep[shown[heads]])
    r["key"][shown], r["key2"][shown] = one[back], two[back]
    key = np.where(hidden, textnum.mix(r["doc"].astype(U)), r["key"])
    r["state"] = flag * FLAG | (r["state"] & ASK) | np.where(hidden, 0, SHOWN).astype(np.uint8)
    r["shard"] = np.full(len(keep), shard)
    none = np.zeros(len(runs["doc"]), U)
    runs = runs | {"key": none, "key2": none, "shard": none, "state": np.full(len(none), FLAG, np.uint8)}
    key = np.concatenate([key, textnum.mix(runs["doc"].astype(U))])
    return rows(n_bins, key, {c: np.concatenate([r[c].astype(KINDS[c]), runs[c].astype(KINDS[c])]) for c in WINDOW})


def settled_windows(table: pa.Table, ordered: bool) -> pa.Table:
    """Step 2 for one bin: for each document the runs (place, count) of repeated windows."""
    r = read(table, WINDOW)
    flag = r["state"] & FLAG > 0
    shown = np.flatnonzero(r["state"] >= SHOWN)
    if len(shown):
        s = {c: v[shown] for c, v in r.items()}
        flag[shown] |= merge_shards(s, ordered) & (s["state"] & ASK > 0)
    return pa.Table.from_batches([answers(r["doc"][flag], r["mark"][flag], place=r["place"][flag], count=r["count"][flag])])


def per_document(found: DataFrame, *columns: str) -> DataFrame:
    """One row for each document; a document's lists are bounded by its own length."""
    return found.groupBy("doc", "mark").agg(*[F.collect_list(c).alias(c) for c in columns])


def joined(parts: pa.Array, kind: str) -> list[np.ndarray]:
    """Raw lists of each document as one array (empty where there is no answer)."""
    return [np.frombuffer(b"".join(p or ()), KINDS[kind]) for p in parts.to_pylist()]


def covered(n: int, window: int, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which of n symbols lie in a flagged window."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place.astype(np.int64) + count + window - 1, -1)
    return np.cumsum(edge[:n]) > 0


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc, mark, text: mark is a checksum of the text, so that rows with one id but other texts stay apart."""
    return df.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("text")).withColumn("mark", F.coalesce(F.crc32("text"), F.lit(0)).bitwiseAND(0x7FFFFFFF).cast("int")).select("doc", "mark", "text")


def resolve(
    docs: DataFrame,
    spec: Spec,
    collect: Callable[[pa.RecordBatch, int, dict[int, tuple[int, int]]], pa.RecordBatch | None],
    open_windows: Callable[[pa.RecordBatch, int, Iterator[int]], Iterator[pa.RecordBatch | None]],
    finish: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    bin_bytes: int = 4 << 20,
) -> DataFrame:
    """The whole exchange over (doc, mark, text). The texts move once, by document key; both joins read that exchange."""
    n_bins = bins(docs, bin_bytes)

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[int, int]] = {}
        for b in batches:
            if b.num_rows and (out := collect(b, n_bins, known)) is not None:
                yield out
        release()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = itertools.count(TaskContext.get().partitionId() << 32)  # a number for each shard of the whole job
        for b in batches:
            if b.num_rows:
                yield from (out for out in open_windows(b, n_bins, shards) if out is not None)
        release()

    # Both joins must see the very same input, or Spark would exchange the texts twice: an inner join adds a test for
    # null keys, so the test is made for both, and rows without an id come back at the end.
    nameless = docs.where("doc IS NULL").select("*", *[F.lit(None).cast("array<binary>").alias(c) for c in ("place", "count")])
    docs = docs.where("doc IS NOT NULL")
    raw = lambda names: "bin int, " + ", ".join(f"{c} binary" for c in names)
    records = docs.mapInArrow(collected, raw(SUPER))
    supers_ = records.groupBy("bin").applyInArrow(lambda t: settled_supers(t, spec.ordered), "doc long, mark int, place binary, state binary")
    found = per_document(supers_, "place", "state")
    held = docs.join(found.hint("shuffle_hash"), ["doc", "mark"]).select("doc", "mark", "text", "place", "state")
    windows = held.mapInArrow(opened, raw(WINDOW))
    windows_ = windows.groupBy("bin").applyInArrow(lambda t: settled_windows(t, spec.ordered), "doc long, mark int, place binary, count binary")
    flags = per_document(windows_, "place", "count")
    both = docs.join(flags.hint("shuffle_hash"), ["doc", "mark"], "left").select("doc", "mark", "text", "place", "count")
    return by_batch(both.union(nameless), finish, schema)
