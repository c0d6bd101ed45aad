"""One dictionary for each group of rows, trained where the group is; and the same vocabulary trained in batch rounds."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..matching import Matcher, identity_tokens
from ..training import train_rows
from . import codec


def group_dictionaries(df: DataFrame, group: str, value: str, order_by: Sequence[str], config: Config = Config(), pool_factor: float = 4.0) -> DataFrame:
    """group, tokens ARRAY<BINARY>: a dictionary per group. What reaches a task is bounded whatever a group's size: a
    group within the budget comes whole (and trains exactly as it would alone); of a larger one, rows whose key hash
    passes a threshold worth ``pool_factor`` budgets. A null group is a group; null values are no rows."""
    rows = df.select(F.col(group).alias("g"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)], F.col(value).cast("binary").alias("v")).where("v IS NOT NULL")
    keys = [f"k{i}" for i in range(len(order_by))]
    sizes = rows.groupBy("g").agg(F.sum(F.octet_length("v")).alias("bytes"), F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(pool_factor * config.budget) / F.col("bytes") + 64 / F.col("n"))
    shares = sizes.select(F.col("g").alias("gg"), F.when(F.col("bytes") > config.budget, share).otherwise(1.0).alias("share"))
    pool = rows.join(shares, rows["g"].eqNullSafe(shares["gg"])).where(F.pmod(F.xxhash64(F.lit(42), *keys), F.lit(1 << 52)) < F.col("share") * (1 << 52)).drop("gg", "share")
    kind = dict(rows.dtypes)["g"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in [*keys, "v"]])
        tokens = train_rows(table["v"].to_pylist(), config)
        return pa.table({group: table["g"].slice(0, 1), "tokens": pa.array([tokens], pa.list_(pa.binary()))})

    return pool.groupBy("g").applyInArrow(run, f"`{group}` {kind}, tokens array<binary>")


def encode_grouped(df: DataFrame, dictionaries: DataFrame | dict, group: str, value: str, config: Config = Config(), out: str = "ids") -> DataFrame:
    """df with value replaced by ids under its group's dictionary. Rows stream through tasks in batches: each batch loads
    the dictionaries of its groups, so no group has to fit a task. Groups are few enough to broadcast their dictionaries
    (at most 65,536 tokens each); their number is checked."""
    tables = collected(dictionaries, group)
    shared = df.sparkSession.sparkContext.broadcast(tables)
    longest = config.max_token_length
    return _per_row(df, group, value, out, pa.list_(pa.int32()), "array<int>", lambda: {g: Matcher(longest, t).parse for g, t in shared.value.items()})


def decode_grouped(df: DataFrame, dictionaries: DataFrame | dict, group: str, column: str = "ids", out: str = "value") -> DataFrame:
    """The inverse of encode_grouped, as STRING."""
    shared = df.sparkSession.sparkContext.broadcast(collected(dictionaries, group))

    def joiner(t: list[bytes]):
        return lambda ids: b"".join([t[i] for i in ids])

    found = _per_row(df, group, column, out, pa.binary(), "binary", lambda: {g: joiner(t) for g, t in shared.value.items()})
    return found.withColumn(out, F.col(out).cast("string"))


MOST_GROUPS = 256


def collected(dictionaries: DataFrame | dict, group: str) -> dict:
    """The dictionaries by group. What comes from here may stand in for the DataFrame, so that groups train only once."""
    if isinstance(dictionaries, dict):
        return dictionaries
    rows = dictionaries.limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: encode them in parts")
    return {r[group]: [bytes(t) for t in r["tokens"]] for r in rows}


def _per_row(df: DataFrame, group: str, column: str, out: str, kind: pa.DataType, sql_kind: str, make) -> DataFrame:
    """A function by group on every row, in ``codec.pieces`` of a batch."""
    names = df.columns
    g, at = names.index(group), names.index(column)
    if sql_kind == "array<int>":
        df = df.withColumn(column, F.col(column).cast("binary"))
    weight = 1 if sql_kind == "array<int>" else 16  # of a byte, or of an id: what its token may take is not known here

    def run(batches):
        functions = make()
        for whole in batches:
            for start, n in codec.pieces(codec.lengths(whole.column(at)) * weight + 8):
                b = whole.slice(start, n)
                values = (None if v is None else functions[k](v) for k, v in zip(b.column(g).to_pylist(), b.column(at).to_pylist()))
                done = codec.listed(values) if kind == pa.list_(pa.int32()) else pa.array(list(values), kind)
                yield pa.RecordBatch.from_arrays([done if i == at else c for i, c in enumerate(b.columns)], names=[out if i == at else n for i, n in enumerate(names)])

    return df.mapInArrow(run, ", ".join(f"`{out if n == column else n}` {sql_kind if n == column else k}" for n, k in df.dtypes))


def batch_dictionary(df: DataFrame, value: str, key: Sequence[str], rounds: int = 8, merges: int = 32, threshold: int = 2, max_token_length: int = 0) -> list[bytes]:
    """A documented alternative to the online trainer that counts pairs over ALL rows, in rounds: parse, count adjacent
    pairs with one grouped aggregate, merge the most frequent ones. It gives another dictionary than the online trainer,
    independent of row order; key columns need not be unique. Only the top pairs of a round reach the driver."""
    tokens = identity_tokens()
    for _ in range(rounds):
        rows = codec.encode(df.select(F.col(value).cast("binary").alias("v")), "v", tokens, max_token_length)
        pairs = rows.select(F.explode(F.when(F.size("tokens") > 1, F.arrays_zip(F.slice("tokens", F.lit(1), F.size("tokens") - 1).alias("a"), F.slice("tokens", F.lit(2), F.size("tokens") - 1).alias("b")))).alias("p"))
        counts = pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
        top, have, added = counts.orderBy(F.desc("n"), "a", "b").limit(merges).collect(), set(tokens), 0
        for r in top:
            merged = tokens[r.a] + tokens[r.b]
            if merged not in have and len(tokens) < 65536 and (max_token_length <= 0 or len(merged) <= max_token_length):
                tokens.append(merged)
                have.add(merged)
                added += 1
        if not added:
            break
    return tokens

