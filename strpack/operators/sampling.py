"""Deterministic training samples.

Two orders exist. ``exact`` shuffles row ordinals with a linear congruential generator (seed 42) and needs one integer
per row on the driver, so it serves tables up to a row limit. ``hash`` orders rows by a seeded hash of their key and value,
which needs no global state: rows pass a threshold computed from exact totals, and only what passes - a few times the budget -
is sorted. Keys may repeat: rows of one key have places of their own, and equal rows are sorted as one with their number.
Either way what reaches the trainer is bounded by the byte budget plus one row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice, repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.templates import OTHER, template_key_column

SPACE = 1 << 52


def permutation(n: int) -> list[int]:
    """Fisher-Yates from the last ordinal down, with 64-bit states s -> s * 6364136223846793005 + 1442695040888963407."""
    out, state, mask = list(range(n)), 42, (1 << 64) - 1
    for i in range(n - 1, 0, -1):
        state = state * 6364136223846793005 + 1442695040888963407 & mask
        j = state % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def budget_prefix(sizes: Sequence[int], budget: int) -> int:
    """How many leading rows it takes to reach the budget, the row that crosses it included."""
    total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= budget:
            return i + 1
    return len(sizes)


def quotas(counts: Sequence[int], target: int) -> list[tuple[int, int]]:
    """(cluster, quota) by largest remainder. The list is in order of falling remainder where rows were left over to
    hand out, else in the given order."""
    total = sum(counts)
    exact = [c * target / total for c in counts]
    rows = [[i, int(x), x - int(x)] for i, x in enumerate(exact)]
    left = target - sum(r[1] for r in rows)
    if left > 0:
        rows.sort(key=lambda r: -r[2])
        for k in range(left):
            rows[k % len(rows)][1] += 1
    return [(r[0], r[1]) for r in rows]


def stratified_order(keys: Sequence, sizes: Sequence[int], budget: int, clusters: int) -> list[int]:
    """Positions to sample, in training order, of rows given in shuffled order: proportional quotas per cluster, then
    rows in turn from every cluster until the budget is reached."""
    groups: dict = {}
    for i, k in enumerate(keys):
        if k not in groups and clusters > 0 and len(groups) >= clusters:
            k = OTHER
        groups.setdefault(k, []).append(i)
    rows = list(groups.values())
    total = sum(sizes)
    target = min(max(int(budget / (total / len(sizes))), 1), len(sizes))
    plan = quotas([len(g) for g in rows], target)
    out, used, taken = [], 0, {}
    for c, quota in plan:
        head = rows[c][:quota]
        out += head
        used += sum(sizes[i] for i in head)
        taken[c] = len(head)
        if head and used >= budget:
            return out
    while used < budget:
        before = len(out)
        for c, _ in plan:
            if taken[c] < len(rows[c]):
                out.append(rows[c][taken[c]])
                used += sizes[out[-1]]
                taken[c] += 1
                if used >= budget:
                    break
        if len(out) == before:
            break
    return out


def byte_budget(df: DataFrame, value: str, order: Sequence[Column | str], budget: int, times: Column | None = None) -> DataFrame:
    """Rows, in the given order, until their bytes reach the budget (the crossing row included). df should be a pool
    already narrowed down to about the budget, since a running sum is one sorted partition. times: how many equal rows
    each stands for."""
    running = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    size = F.octet_length(F.col(value).cast("binary"))
    size = size if times is None else size * times
    return df.withColumn("__before", F.sum(size).over(running) - size).where(F.col("__before") < budget).drop("__before")


def stratified_quotas(df: DataFrame, key: str, seq: str, target: int, clusters: int) -> DataFrame:
    """cluster, n, quota for rows with a template key and a sequence number: the relational form of ``quotas``. Only the
    ``clusters`` keys seen first keep their names; counting is a grouped aggregate, the windows run over clusters."""
    seen = df.groupBy(key).agg(F.min(seq).alias("__first"), F.count("*").alias("__n"))
    kept = F.broadcast(seen.orderBy("__first").limit(clusters).select(F.col(key).alias("__key"), F.lit(True).alias("__kept")))
    named = seen.join(kept, seen[key] == kept["__key"], "left").select(F.when(F.col("__kept"), F.col(key)).otherwise(OTHER).alias("cluster"), "__first", "__n")
    totals = named.groupBy("cluster").agg(F.sum("__n").alias("n"), F.min("__first").alias("__first"))
    every = W.partitionBy(F.lit(0))
    exact = F.col("n") * F.lit(target) / F.sum("n").over(every)
    part = totals.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact"))
    left = F.lit(target) - F.sum("__floor").over(every)
    rank = F.row_number().over(every.orderBy(F.desc(F.col("__exact") - F.col("__floor")), "__first"))
    size = F.count("*").over(every)
    extra = F.floor((left - rank) / size) + 1  # leftovers go round the list; more than one round is possible
    return part.select("cluster", "n", (F.col("__floor") + F.greatest(extra, F.lit(0))).cast("long").alias("quota"))


def repeated(rows: Iterable[tuple[bytes, int]], budget: int) -> list[bytes]:
    """Each value as many times as it is there, in order, until their bytes reach the budget."""
    out, left = [], budget
    for v, n in rows:
        if left <= 0:
            break
        n = min(n, -(-left // max(1, len(v))))  # empty values teach nothing
        out += [v] * n
        left -= n * len(v)
    return out


def training_sample(df: DataFrame, value: str, order_by: Sequence[str], config: Config, mode: str = "auto", exact_rows: int = 1_000_000, exact_bytes: int = 256 << 20) -> tuple[list[bytes], str]:
    """(rows in training order, mode used). Null values are no rows. mode: exact, hash, or auto (exact within limits)."""
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)], F.col(value).cast("binary").alias("v")).where("v IS NOT NULL")
    keys = [f"k{i}" for i in range(len(order_by))]
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()
    if mode == "auto":
        mode = "exact" if n <= exact_rows and total <= exact_bytes else "hash"
    if not n:
        return [], mode
    if mode == "exact":
        numbered = rows.select("v", (F.row_number().over(W.orderBy(*keys, "v")) - 1).alias("ordinal"))
        sizes_of = [F.octet_length("v").alias("size")] + ([F.xxhash64(template_key_column(F.col("v"))).alias("key")] if config.stratified else [])
        if total <= config.budget:
            table = numbered.orderBy("ordinal").select("v").toArrow()
            values = table["v"].to_pylist()
            return [values[i] for i in permutation(n)], mode
        facts = numbered.orderBy("ordinal").select(*sizes_of).toArrow()
        order, size = permutation(n), facts["size"].to_pylist()
        if config.stratified:
            key = facts["key"].to_pylist()
            chosen = [order[i] for i in stratified_order([key[i] for i in order], [size[i] for i in order], config.budget, config.clusters)]
        else:
            chosen = order[: budget_prefix([size[i] for i in order], config.budget)]
        wanted = df.sparkSession.createDataFrame(list(enumerate(chosen)), "seq int, ordinal int")
        return numbered.join(F.broadcast(wanted), "ordinal").orderBy("seq").select("v").toArrow()["v"].to_pylist(), mode
    if mode != "hash":
        raise ValueError(f"unknown sampling mode {mode!r}")
    place = rows.withColumn("seq", F.pmod(F.xxhash64(F.lit(42), *keys, "v"), F.lit(SPACE)))
    if total <= config.budget:
        return place.orderBy("seq", *keys, "v").select("v").toArrow()["v"].to_pylist(), mode
    if config.stratified:
        return _stratified_by_hash(place, keys, n, total, config), mode
    share = 2.0 * config.budget / total + 64.0 / n
    while True:
        passed = place.where(F.col("seq") < int(min(1.0, share) * SPACE))
        if share >= 1 or (passed.agg(F.sum(F.octet_length("v"))).first()[0] or 0) >= config.budget:
            pool = passed.groupBy("seq", *keys, "v").agg(F.count("*").alias("times"))
            chosen = byte_budget(pool, "v", ["seq", *keys, "v"], config.budget, F.col("times"))
            table = chosen.orderBy("seq", *keys, "v").select("v", "times").toArrow()
            return repeated(zip(table["v"].to_pylist(), table["times"].to_pylist()), config.budget), mode
        share *= 4


def _stratified_by_hash(place: DataFrame, keys: list[str], n: int, total: int, config: Config) -> list[bytes]:
    """Counts per template are exact over all rows; only rows that a quota could reach are sorted."""
    marked = place.withColumn("key", template_key_column(F.col("v")))
    target = min(max(int(config.budget / (total / n)), 1), n)
    counts = marked.groupBy("key").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    seen = counts.orderBy("first", "key").limit(config.clusters).collect()
    named = {r.key: r.n for r in seen}
    counts_of: dict[str, int] = named | {OTHER: n - sum(named.values())}
    shares = {k: min(1.0, (4.0 * target * c / n + 64) / max(c, 1)) for k, c in counts_of.items()}
    start = max(r["first"] for r in seen) / SPACE  # templates without a name of their own begin after those with one
    shares[OTHER] = start + (1 - start) * shares[OTHER]
    while True:
        share = F.broadcast(place.sparkSession.createDataFrame([(k, shares[k]) for k in named], "key string, share double"))
        passed = marked.join(share, "key", "left").where(F.col("seq") < F.coalesce("share", F.lit(shares[OTHER])) * SPACE)
        pool = passed.groupBy("seq", *keys, "v", "key").agg(F.count("*").alias("times")).orderBy("seq", *keys, "v").select("v", "key", "times").toArrow()
        values, times = pool["v"].to_pylist(), pool["times"].to_pylist()
        cluster = [k if k in named else OTHER for k in pool["key"].to_pylist()]
        found: Counter[str] = Counter()
        for k, t in zip(cluster, times):
            found[k] += t
        short = [k for k, c in counts_of.items() if shares[k] < 1 and found[k] < min(c, target * c / n + 1)]  # few rows that are equal
        if not short:
            break
        shares |= {k: min(1.0, 4 * shares[k]) for k in short}
    size = [len(v) for v in values]
    order = [c for c in dict.fromkeys(cluster)]
    plan = quotas([max(counts_of[c], 1) for c in order], target)
    rows: dict[str, list[Iterator[int]]] = {c: [] for c in order}
    for i, c in enumerate(cluster):
        rows[c].append(repeat(i, times[i]))
    feed = {c: chain.from_iterable(r) for c, r in rows.items()}
    out, used = [], 0
    for c, quota in plan:
        head = list(islice(feed[order[c]], quota))
        out += head
        used += sum(size[i] for i in head)
        if head and used >= config.budget:
            return [values[i] for i in out]
    while used < config.budget:
        before = len(out)
        for c, _ in plan:
            if used < config.budget and (i := next(feed[order[c]], None)) is not None:
                out.append(i)
                used += size[i]
        if len(out) == before:
            break
    return [values[i] for i in out]
