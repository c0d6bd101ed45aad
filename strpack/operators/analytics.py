"""Token analytics in built-in operators: histogram, codebook, boundaries, sizes, referential checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import TOP_ID_12


def histogram(rows: DataFrame, column: str = "tokens") -> DataFrame:
    """token_id, n. At most 65,536 groups, summed before the exchange."""
    return rows.select(F.explode(column).alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))


def codebook(rows: DataFrame, size: int = 255, column: str = "tokens") -> DataFrame:
    """code, token_id, n: the most frequent ids by falling count, then rising id. The window runs over the histogram."""
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token_id"))
    return histogram(rows, column).withColumn("code", rank - 1).where(F.col("code") < size).select("code", "token_id", "n")


def codebook_payload_size(rows: DataFrame, column: str = "tokens") -> DataFrame:
    """Bytes of the codebook encoding: 6, two for each entry, one for each coded id and three for each other."""
    counts = histogram(rows, column)
    book = codebook(rows, 255, column).select("token_id", F.lit(1).alias("coded"))
    joined = counts.join(F.broadcast(book), "token_id", "left")
    return joined.agg((F.lit(6) + F.coalesce(F.sum(F.when(F.col("coded") == 1, 2 + F.col("n")).otherwise(3 * F.col("n"))), F.lit(0))).cast("long").alias("payload_bytes"))


RANGES = 64
#: Rows, in expectation, whose keys draw the borders between ranges.
BORDER_SAMPLE = 4096


def borders(rows: DataFrame, order_by: Sequence[str], ranges: int = RANGES) -> list[Row]:
    """The keys after which ranges of about equal size end: quantiles of a bounded sample drawn by a hash of the keys, so
    the same rows always have the same borders. rows: anything that has the keys, best before it is encoded."""
    keys, space = F.struct(*order_by), 1 << 40
    n = max(1, rows.count())
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(3), *order_by), F.lit(space)) < min(space, space * max(BORDER_SAMPLE, 64 * ranges) // n)).agg(F.array_sort(F.collect_set(keys)).alias("k"))
    sample = drawn.first()["k"]
    step = max(1, -(-len(sample) // ranges))
    return sample[step - 1 :: step]


def ranged(rows: DataFrame, order_by: Sequence[str], ranges: int = RANGES, out: str = "__p", at: list[Row] | None = None) -> DataFrame:
    """rows with the number of their range of keys, which a row finds by halving. at: the borders, where they are known."""
    found, kinds, keys = borders(rows, order_by, ranges) if at is None else at, dict(rows.dtypes), F.struct(*order_by)
    if not found:
        return rows.withColumn(out, F.lit(0))
    constant = F.array(*[F.struct(*[F.lit(k[c]).cast(kinds[c]).alias(c) for c in order_by]) for k in found])
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(len(found).bit_length()))])
    return rows.withColumn(out, F.aggregate(halves, F.lit(0), lambda n, i: F.when((n + i <= len(found)) & (F.get(constant, n + i - 1) < keys), n + i).otherwise(n)))


def _before(totals: DataFrame) -> DataFrame:
    """__p, before: what comes before each range. At most RANGES + 1 rows meet in the window."""
    one = W.partitionBy(F.lit(0)).orderBy("__p")
    return totals.select("__p", (F.sum("t").over(one) - F.col("t")).alias("before"))


def boundaries(rows: DataFrame, order_by: Sequence[str], column: str = "tokens", at: list[Row] | None = None) -> DataFrame:
    """Keys, and where each row ends in the stream of all ids. Rows are summed per range of keys; only the ranges' totals
    meet in one place. at: known ``borders`` of the keys."""
    ordered = ranged(rows.select(*order_by, F.size(column).cast("long").alias("n")), order_by, at=at)
    before = _before(ordered.groupBy("__p").agg(F.sum("n").alias("t")))
    inside = F.sum("n").over(W.partitionBy("__p").orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0))
    return ordered.withColumn("inside", inside).join(F.broadcast(before), "__p").select(*order_by, (F.col("before") + F.col("inside")).alias("boundary"))


def steps(bounds: DataFrame, order_by: Sequence[str], column: str = "boundary", at: list[Row] | None = None) -> DataFrame:
    """Keys, ``column`` and its step from the boundary before (delta form), range by range: the first of a range counts
    from the greatest boundary of the ranges before it."""
    ordered = ranged(bounds.select(*order_by, column), order_by, at=at)
    last = ordered.groupBy("__p").agg(F.max(column).alias("m"))
    start = last.select("__p", F.coalesce(F.lag("m").over(W.partitionBy(F.lit(0)).orderBy("__p")), F.lit(0)).alias("start"))
    placed = ordered.join(F.broadcast(start), "__p")
    previous = F.coalesce(F.lag(column).over(W.partitionBy("__p").orderBy(*order_by)), F.col("start"))
    return placed.select(*order_by, column, (F.col(column) - previous).alias("step"))


def summed(rows: DataFrame, order_by: Sequence[str], column: str = "step", out: str = "boundary", at: list[Row] | None = None) -> DataFrame:
    """The inverse of ``steps``: rows with the running total of ``column``."""
    ordered = ranged(rows, order_by, at=at)
    before = _before(ordered.groupBy("__p").agg(F.sum(column).alias("t")))
    inside = F.sum(column).over(W.partitionBy("__p").orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0))
    return ordered.withColumn("__inside", inside).join(F.broadcast(before), "__p").withColumn(out, F.col("before") + F.col("__inside")).drop("__p", "before", "__inside")


def varint_size(n: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits."""
    out = F.lit(9)
    for k in range(8, 0, -1):
        out = F.when(n < (1 << (7 * k)), F.lit(k)).otherwise(out)
    return out


def boundary_bytes(rows: DataFrame, column: str = "tokens") -> DataFrame:
    """Bytes of the row boundaries: as 8-byte numbers, and as a first one and steps."""
    n = F.size(column).cast("long")
    return rows.agg(((F.count("*") + 1) * 8 + 4).alias("absolute_bytes"), (F.lit(16) + F.coalesce(F.sum(varint_size(n)), F.lit(0))).cast("long").alias("delta_bytes"))


def stream_sizes(rows: DataFrame, column: str = "tokens") -> DataFrame:
    """n_tokens and the bytes of the two plain encodings."""
    n = F.coalesce(F.sum(F.size(column)), F.lit(0))
    return rows.agg(n.cast("long").alias("n_tokens"), (4 + 2 * n).cast("long").alias("raw16_bytes"), (4 + F.floor((12 * n + 7) / 8)).cast("long").alias("packed12_bytes"))


def space_used(rows: DataFrame, dictionary: Sequence[bytes], bits: int = 16, column: str = "tokens") -> DataFrame:
    """space_used, and full_in_memory with 8 bytes for each of the n + 1 row boundaries."""
    n = F.coalesce(F.sum(F.size(column)), F.lit(0))
    ids = F.floor((12 * n + 7) / 8) if bits == 12 else 2 * n
    fixed = sum(map(len, dictionary)) + 4 * (len(dictionary) + 1)
    used = (ids + F.lit(fixed)).cast("long")
    return rows.agg(used.alias("space_used"), (used + 8 * (F.count("*") + 1)).cast("long").alias("full_in_memory"))


def violations(rows: DataFrame, dict_df: DataFrame, bits: int = 16, column: str = "tokens") -> DataFrame:
    """check, n: how often each structural rule is broken (all 0 for a sound archive)."""
    ids = rows.select(F.explode(column).alias("token_id"))
    unknown = ids.join(F.broadcast(dict_df.select("token_id")), "token_id", "left_anti").agg(F.lit("unknown_id").alias("check"), F.count("*").alias("n"))
    wide = ids.where(F.col("token_id") > (TOP_ID_12 if bits == 12 else 65535)).agg(F.lit("id_too_wide").alias("check"), F.count("*").alias("n"))
    step = F.lag("token_id").over(W.partitionBy(F.lit(0)).orderBy("token_id"))
    gaps = dict_df.withColumn("before", step).where((F.col("token_id") - F.coalesce("before", F.lit(-1))) != 1).agg(F.lit("dictionary_gap").alias("check"), F.count("*").alias("n"))
    empty = dict_df.where("token_len < 1").agg(F.lit("empty_token").alias("check"), F.count("*").alias("n"))
    identity = dict_df.where((F.col("token_id") < 256) & (F.hex("token") != F.lpad(F.hex("token_id"), 2, "0"))).agg(F.lit("identity_token").alias("check"), F.count("*").alias("n"))
    return unknown.union(wide).union(gaps).union(empty).union(identity)
