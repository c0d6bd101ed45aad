"""Near-duplicate groups by SetSketch registers.

Every document becomes the set of its distinct five-word shingles (A-Z lower-cased; fewer words: the whole sequence as
one shingle). The sketch keeps, for each of its registers, the truncated logarithm (base ``b``) of the least value of an
exponentially distributed hash over the set: registers of a union are the maxima of the parts' registers, and two sets
agree in a register with a probability that grows with their similarity.

1. Documents with the same set are one class (grouped aggregate on a 128-bit digest, which carries the registers along);
   the least id stands for it.
2. Bands of registers give buckets. A bucket never sits in one task: its least member and size come from a grouped
   aggregate. Full sets are made once, for the classes that share a bucket with another one, and kept as a table.
3. Every class is paired with the least member of each of its buckets. Candidates are estimated jointly - the maximum
   likelihood similarity given how many registers are greater, less and equal and both set sizes - and whatever could
   reach the threshold is verified on the full sets. Links found are contracted to components.
4. Buckets whose members still lie in several components are taken in blocks of ``block`` members: a task sees two blocks
   at a time and compares registers of members of different components. Of the likely pairs it emits a spanning forest
   first, then the best of each two components, then the rest; contraction in between leaves little for the last round,
   and there is no further round once nothing was held back. No pair of a bucket that could join two components stays
   unjudged, and copies of one text, or near copies of one original, cost about one test each.

With 32 bands of 5 registers a pair at similarity 0.8 is in no common bucket with probability 3e-6 (0.85: 7e-9).

Edge cases: null and blank texts have the empty set and are linked with nothing; ties go to the least id; rows with one
id are one document, linked with whatever any of its texts is linked with, and each row reports its own text's size; a
null id is reported unlinked; very long texts are whole sets like others (a block is bounded in registers, not in text);
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import by_batch, cut, drop_cut, text_of
from .components import components

U = np.uint64


@dataclass(frozen=True)
class Params:
    words: int = 5
    numerator: int = 85  # linked: 100 * intersection >= numerator * union
    bands: int = 32
    rows: int = 5  # registers in a band
    base: float = 1.001
    rate: float = 20.0
    top: int = 65535
    seed: int = 11
    #: Members of a bucket that one side of a comparison holds.
    block: int = 512
    #: Likely pairs that a task emits for each two components before it emits all.
    best: int = 16
    #: Candidates whose estimate lies this many standard deviations below the threshold are not verified.
    deviations: float = 5.5
    #: Ids up to this number are broadcast (8 bytes each and their hash table) to pick out rows; more are joined by shuffle.
    broadcast_ids: int = 1_000_000

    @property
    def limit(self) -> float:
        t = self.numerator / 100
        return t - self.deviations * float(np.sqrt(t * (1 - t) / (self.bands * self.rows)))


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted within each document) and each document's offsets into them."""
    data = textnum.LOWER[data]
    starts, ends, at = textnum.words(data, offsets)
    hashes = textnum.word_hashes(data, starts, ends)
    g = textnum.grams(hashes, n)
    parts, sizes = [], np.zeros(len(offsets), np.int64)
    for i in range(len(offsets) - 1):
        a, b = at[i], at[i + 1]
        if b - a >= n:
            x = np.sort(g[a : b - n + 1])
            if len(x) > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:  # fewer words: the whole sequence, told apart from longer ones by its length
            x = textnum.mix(textnum.grams(hashes[a:b], int(b - a)) + U(b - a))
        else:
            continue
        parts.append(x)
        sizes[i + 1] = len(x)
    return np.concatenate(parts) if parts else np.zeros(0, U), np.cumsum(sizes)


def sketch(hashes: np.ndarray, offsets: np.ndarray, p: Params) -> np.ndarray:
    """(documents, registers) uint16; 0 for empty sets."""
    m = p.bands * p.rows
    rng = np.random.default_rng(p.seed)
    mul = rng.integers(0, 1 << 31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, m, dtype=np.uint32)
    least = np.full((len(offsets) - 1, m), 0xFFFFFFFF, np.uint32)
    folded = ((hashes >> U(32)) ^ hashes).astype(np.uint32)
    for i in range(len(offsets) - 1):
        for a in range(offsets[i], offsets[i + 1], 1024):
            y = folded[a : min(a + 1024, offsets[i + 1]), None] * mul
            y += add
            np.minimum(least[i], y.min(0), out=least[i])
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0) / p.rate
    k = np.clip(np.floor(1 - np.log(h) / np.log(p.base)) + 20000, 1, p.top)
    k[offsets[1:] == offsets[:-1]] = 0
    return k.astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float = 1.001) -> np.ndarray:
    """Maximum-likelihood similarity of pairs (rows of registers) with known set sizes."""
    return estimate((a > b).sum(1), (a < b).sum(1), a.shape[1], na, nb, base)


def estimate(greater: np.ndarray, less: np.ndarray, registers: int, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """The same from the numbers of registers that are greater and less. With u, v the shares of the two sizes, a register
    of the first is greater with probability f(u - v J), of the second with f(v - u J), where f(x) =
    -log_b(1 - x (b - 1) / b); the log-likelihood is concave in J and is maximised by bisection on its slope."""
    greater, less = greater.astype(float), less.astype(float)
    equal = registers - greater - less
    u, v = na / (na + nb), nb / (na + nb)
    c, log_b = (base - 1) / base, np.log(base)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    f = lambda x: -np.log1p(-x * c) / log_b
    d = lambda x: c / (1 - x * c) / log_b
    for _ in range(40):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        same = np.maximum(1 - f(x) - f(y), 1e-12)
        slope = -greater * v * d(x) / f(x) - less * u * d(y) / f(y) + equal * (v * d(x) + u * d(y)) / same
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def _sketches(docs: DataFrame, p: Params) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = textnum.flat(batch.column(1))
        n, one, two, regs = [], [], [], []
        for _, _, part, at in textnum.blocks(data, offsets):
            x, o = shingles(part, at, p.words)
            size = np.diff(o)
            n.append(size)
            for out, values in ((one, x), (two, textnum.mix(x ^ U(0x5851F42D4C957F2D)))):
                total = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
                out.append(textnum.mix(total[o[1:]] - total[o[:-1]]).view(np.int64))
            regs += [r.tobytes() for r in sketch(x, o, p)]
        cat = lambda parts: pa.array(np.concatenate(parts))
        return pa.record_batch([batch.column(0), cat(n), cat(one), cat(two), pa.array(regs, pa.binary())], names=["doc_id", "n", "one", "two", "regs"])

    return by_batch(docs, run, "doc_id long, n long, one long, two long, regs binary")


def _sets(docs: DataFrame, p: Params) -> DataFrame:
    """id, items: full sets as sorted runs of 64-bit hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = textnum.flat(batch.column(1))
        out = []
        for _, _, part, at in textnum.blocks(data, offsets):
            x, o = shingles(part, at, p.words)
            out += [x[a:b].tobytes() for a, b in zip(o[:-1], o[1:])]
        return pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["id", "items"])

    return by_batch(docs, run, "id long, items binary")


def _of(df: DataFrame, ids: DataFrame, n: int, p: Params, key: str = "id") -> DataFrame:
    """The rows of df with one of the n ids."""
    ids = ids.select(F.col("id").alias(key))
    return df.join(F.broadcast(ids) if n <= p.broadcast_ids else ids, key, "left_semi")


def _close(na: np.ndarray, nb: np.ndarray, p: Params) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold at all."""
    return np.minimum(na, nb) * 100 >= p.numerator * np.maximum(na, nb)


def _likely(pairs: DataFrame, signs: DataFrame, p: Params) -> DataFrame:
    """Candidate pairs (a, b) whose joint estimate could reach the threshold."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        regs = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (4, 5)]
        ok = _close(c[2], c[3], p) & (joint_estimate(regs[0], regs[1], c[2].astype(float), c[3].astype(float), p.base) >= p.limit)
        return pa.record_batch([pa.array(c[0][ok]), pa.array(c[1][ok])], names=["a", "b"])

    side = lambda x: signs.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("regs").alias("r" + x))
    return by_batch(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb"), run, "a long, b long")


def chosen_pairs(start: np.ndarray, cross: np.ndarray, comp: np.ndarray, n: np.ndarray, regs: np.ndarray, side: np.ndarray, mode: int, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several groups of members (their first rows: start) the likely pairs between different components - in a group
    that is crossed, between different sides - that are to be emitted, and whether their group holds others back. mode:
    -1 a spanning forest of the likeliest, otherwise so many for each two components, 0 all."""
    end = np.append(start[1:], len(comp))
    group = np.repeat(np.arange(len(start)), end - start)
    last, crossed, registers = end[group], cross[group], regs.shape[1]
    found: list[tuple[np.ndarray, ...]] = []
    rows = np.arange(len(comp))
    for step in range(1, int((end - start).max(initial=0))):  # all pairs that lie so far apart, in all groups at once
        rows = rows[rows + step < last[rows]]
        x, y = rows, rows + step
        ok = (comp[x] != comp[y]) & _close(n[x], n[y], p) & (~crossed[x] | (side[x] != side[y]))
        for a in range(0, int(ok.sum()), 8192):
            u = x[ok][a : a + 8192]
            v = u + step
            same = (regs[u] == regs[v]).sum(1)
            near = same >= registers // 4  # far below what a pair near the limit has in common
            u, v, same = u[near], v[near], same[near]
            found.append((u, v, (regs[u] > regs[v]).sum(1), same))
    none = np.zeros(0, np.int64)
    if not found:
        return none, none, none.astype(bool)
    x, y, more, same = (np.concatenate(c) for c in zip(*found))
    j = estimate(more, registers - more - same, registers, n[x].astype(float), n[y].astype(float), p.base) if len(x) else none
    ok = np.flatnonzero(j >= p.limit)
    ok = ok[np.lexsort((y[ok], x[ok], -j[ok], group[x[ok]]))]
    x, y = x[ok], y[ok]
    keep = np.ones(len(x), bool)
    if mode > 0:
        low, high = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
        order = np.lexsort((np.arange(len(x)), high, low, group[x]))
        key = [k[order] for k in (group[x], low, high)]
        new = np.ones(len(x), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        head = np.flatnonzero(new)
        keep[order] = np.arange(len(x)) - head[np.cumsum(new) - 1] < mode
    elif mode < 0:
        at: dict[tuple[int, int], tuple[int, int]] = {}

        def root(v: tuple[int, int]) -> tuple[int, int]:
            while (up := at.get(v, v)) != v:
                at[v] = at.get(up, up)
                v = up
            return v

        for k, (g, u, v) in enumerate(zip(group[x].tolist(), comp[x].tolist(), comp[y].tolist())):
            u, v = root((g, u)), root((g, v))
            keep[k] = u != v
            at[u] = v
    held = np.zeros(len(start), bool)
    held[group[x[~keep]]] = True
    return x[keep], y[keep], held[group[x[keep]]]


def _crossing(members: DataFrame, signs: DataFrame, mode: int, p: Params) -> DataFrame:
    """a, b, more: likely pairs from the members (bucket, id, component, size) of open buckets. A bucket of several blocks
    is compared two blocks at a time; groups arrive sorted, so that a task holds one of them, at most two blocks."""
    parts = F.ceil(F.col("size") / p.block).cast("int")
    own = F.pmod(F.xxhash64(F.lit(5), "id"), F.col("parts")).cast("int")
    spread = members.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = spread.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "component", (F.col("own") < F.col("other")).alias("side"))
    rows = rows.join(signs.select("id", "n", "regs"), "id").select("bucket", "i", "j", "id", "component", "n", "side", "regs")
    # A fixed number of partitions: these rows are few bytes and much work, and would be coalesced otherwise.
    width = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = [table.column(i).to_numpy() for i in range(3)]
            start = np.array([a for a, _ in _groups(key)])
            regs = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint16).reshape(table.num_rows, -1)
            ids, comp, n, side = (table.column(i).to_numpy() for i in (3, 4, 5, 6))
            size = np.diff(np.append(start, table.num_rows))
            work = np.cumsum(size * size)
            for a, b in _runs(work, PAIRS):
                i, j = start[a], start[b] if b < len(start) else table.num_rows
                x, y, more = chosen_pairs(start[a:b] - i, (key[1] != key[2])[start[a:b]], comp[i:j], n[i:j], regs[i:j], side[i:j], mode, p)
                if len(x):
                    x, y = ids[i:j][x], ids[i:j][y]
                    yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(more)], names=["a", "b", "more"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(i).to_numpy() for i in range(3)]
            last = _groups(key)[-1][0]  # the last group may go on in the next batch
            if last or held and any(h[0] != held[-1].column(i)[-1].as_py() for i, h in enumerate(key)):
                yield from settle(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from settle(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a long, b long, more boolean")


#: Pairs, counted twice, that groups taken together may have.
PAIRS = 1 << 21


def _runs(work: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of groups of about so much work together, given the running total of it; a larger group is a run of its own."""
    out, a = [], 0
    while a < len(work):
        b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + most, "right")))
        out.append((a, b))
        a = b
    return out


def _groups(key: list[np.ndarray]) -> list[tuple[int, int]]:
    """Runs of equal keys."""
    new = np.zeros(len(key[0]), bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new).tolist()
    return list(zip(at, [*at[1:], len(new)]))


def _verified(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs whose full sets reach the threshold. Only the sets of these pairs move."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    own = _of(sets, ids, ids.count(), p)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= p.numerator * (len(x) + len(y) - both))
        return pa.record_batch([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    side = lambda x: own.select(F.col("id").alias(x), F.col("items").alias("s" + x))
    out = cut(by_batch(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb"), run, "a long, b long"))
    drop_cut(ids)
    return out


def _contracted(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) after further links; both tables that went in are dropped."""
    at = lambda x: found.select(F.col("node").alias(x), F.col("component").alias("t" + x))
    new = cut(links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).where("a <> b").distinct())
    if new.isEmpty():
        for x in (links, new):
            drop_cut(x)
        return found
    over = components(new)
    labels = found.union(new.select("a", "a")).union(new.select("b", "b")).toDF("node", "at").dropDuplicates(["node"])
    out = cut(labels.join(over.toDF("at", "to"), "at", "left").select("node", F.coalesce("to", "at").alias("component")))
    for x in (found, links, new, over):
        drop_cut(x)
    return out


def groups(df: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links), kept (doc_id = component_id)."""
    docs = text_of(df, key, text=text).select(F.col(key).cast("long").alias("doc_id"), "text")
    s = cut(_sketches(docs, p))
    some = s.where("n > 0 AND doc_id IS NOT NULL")
    reps = cut(some.groupBy("one", "two", "n").agg(F.min("doc_id").alias("id"), F.first("regs").alias("regs")))
    # Only digests move here, and a hot class is split at run time.
    classes = reps.select("one", "two", "n", F.col("id").alias("rep"))
    member = cut(s.select("doc_id", "n", "one", "two").join(classes, ["one", "two", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")))
    drop_cut(s)

    width = 2 * p.rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda i: F.xxhash64(i, F.substr("regs", i * width + 1, F.lit(width))))
    in_band = reps.select("id", F.explode(keys).alias("bucket"))
    shared = in_band.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("size")).where("least < most")
    buckets = cut(in_band.join(shared.select("bucket", "least"), "bucket").select("bucket", "id", "least"))
    ids = cut(buckets.select("id").distinct())
    n = ids.count()
    signs = cut(_of(reps.select("id", "n", "regs"), ids, n, p))
    sets = cut(_sets(_of(docs, ids, n, p, "doc_id").dropDuplicates(["doc_id", "text"]), p))
    for x in (reps, ids):
        drop_cut(x)

    # Texts under one id belong together whatever they are.
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most").select("doc_id", "a")
    links = cut(member.join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a < b").distinct())
    found = components(links)
    drop_cut(links)
    tested = [cut(_likely(buckets.select(F.col("least").alias("a"), F.col("id").alias("b")).where("a < b").distinct(), signs, p))]
    found = _contracted(found, _verified(tested[0], sets, p))
    buckets_ = buckets.select("bucket", "id")
    for mode in (-1, p.best, 0):
        placed = buckets_.join(found, buckets_["id"] == found["node"], "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
        open_ = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).where("x < y").select("bucket", "size")
        left = cut(placed.join(open_, "bucket").select("bucket", "id", "component", "size"))
        if left.isEmpty():
            drop_cut(left)
            break
        pairs = cut(_crossing(left, signs, mode, p).groupBy("a", "b").agg(F.max("more").alias("more")))
        drop_cut(left)
        fresh = pairs.select("a", "b")
        for x in tested:
            fresh = fresh.join(x.select("a", "b"), ["a", "b"], "left_anti")
        tested.append(pairs)
        fresh = cut(fresh)
        if not fresh.isEmpty():
            found = _contracted(found, _verified(fresh, sets, p))
        drop_cut(fresh)
        if pairs.where("more").isEmpty():
            break
    for x in (buckets, signs, sets, *tested):
        drop_cut(x)
    placed = found.select(F.col("node").alias("rep"), "component")
    out = member.join(placed, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
