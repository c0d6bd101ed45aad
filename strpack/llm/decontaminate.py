"""Benchmark decontamination: which documents hold which benchmark items, in DataFrame operations only.

Texts are lower-cased and split into words; shingles are five words. A window has as many words as an item.

1. Seeds. A window that reaches the threshold shares shingles with its item, so the shingles of every document meet the
   items' shingles in one equi-join (broadcast while the item side is small, else shuffled). A running sum over these
   meetings gives, for every start in the document, the most weight a window there can have in common with the item;
   every start where that can reach the threshold is a window, wherever its shingles stand in the item.
2. Fingerprints. Each such window, unless its own weight rules it out, and each item get a 64-bit SimHash of their shingles, weighted by length in characters.
3. Multi-index Hamming. Fingerprints are cut into radius + 1 blocks; two within the radius agree in some block, so an
   equi-join on (window size, block number, block value) finds all of them; the exact distance follows.
4. Verification. Weight of the common shingles over weight of all shingles of both, at least the threshold, exactly.

At similarity 0.8 two fingerprints differ in 9.7 bits on average (standard deviation 2.9); a radius of 23 misses two in a
million of those at the very threshold, and fewer above it.

Edge cases: null and short texts (under five words) match nothing; items under five words are too short to identify a
leak and are left out; an item repeated under several ids is reported for each; repeated rows and null ids are reported
as they are; very long texts are read whole; ties in similarity go to the earliest window; extra columns are not read;
empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

N = 5
SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Params:
    tenths: int = 8  # similarity at least tenths / 10
    radius: int = 23
    #: Item shingles up to this number are broadcast (16 bytes each and their hash table); more are joined by shuffle.
    broadcast_shingles: int = 1_000_000
    #: Keys of texts with a window, up to this number, are broadcast (16 bytes each and their hash table).
    broadcast_keys: int = 1_000_000


def words(text: Column) -> Column:
    """Words, lower-cased; a blank text is one empty word, which no rule here accepts."""
    return F.split(F.lower(F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))), SPACE)


def _bind(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(ws: Column) -> Column:
    """Hash of every five consecutive words."""

    def of(h: Column) -> Column:
        at = F.when(F.size(h) >= N, F.sequence(F.lit(0), F.size(h) - N)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(N)]))

    return _bind(F.transform(ws, lambda w: F.xxhash64(w)), of)


def shingle_texts(ws: Column) -> Column:
    """Distinct shingles as texts, for the exact step."""
    at = F.when(F.size(ws) >= N, F.sequence(F.lit(1), F.size(ws) - N + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(ws, i, F.lit(N)), " ")))


def simhash(shingles: Column) -> Column:
    """64 weighted majority votes."""

    def votes(pairs: Column) -> Column:
        def bit(b: Column) -> Column:
            total = F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, s: acc + F.when(F.getbit(s["h"], b) == 1, s["w"]).otherwise(-s["w"]))
            return F.when(total > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))

    return _bind(F.transform(shingles, lambda s: F.struct(F.xxhash64(s).alias("h"), F.length(s).cast("long").alias("w"))), votes)


def _values(fingerprint: Column, radius: int) -> list[Column]:
    count, out, at = radius + 1, [], 0
    for k in range(count):
        size = (64 - at) // (count - k)
        out.append(F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << size) - 1).cast("long")))
        at += size
    return out


def blocks(fingerprint: Column, radius: int) -> Column:
    """(number, value) of each of radius + 1 blocks."""
    return F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in enumerate(_values(fingerprint, radius))])


def first_block(difference: Column, radius: int) -> Column:
    """Number of the first block in which two fingerprints of this exclusive or agree."""
    return F.coalesce(*[F.when(v == 0, k) for k, v in enumerate(_values(difference, radius))])


def weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))


def ranges(docs: DataFrame, items: DataFrame, p: Params) -> DataFrame:
    """id, text_hash, ranges (size, from, to, room): all starts at which a window of that size may reach the threshold,
    if tenths times the weight of its shingles is at most room."""
    kinds = items.select("size", "ws").distinct().withColumn("item", F.xxhash64("size", F.array_join("ws", " "))).withColumn("total", weight(shingle_texts(F.col("ws"))))
    grams = kinds.select("item", "size", "total", "ws", F.posexplode(shingle_hashes(F.col("ws"))).alias("q", "h"))
    grams = grams.select("item", "size", "total", "h", F.length(F.array_join(F.slice("ws", F.col("q") + 1, F.lit(N)), " ")).cast("long").alias("w")).distinct()
    if grams.count() <= p.broadcast_shingles:
        grams = F.broadcast(grams)
    seen = docs.select("id", "text_hash", F.posexplode(shingle_hashes(words(F.col("text")))).alias("p", "h"))
    met = seen.join(grams, "h").select("id", "text_hash", "item", "size", "total", "p", "w").repartition("id", "text_hash").distinct()
    # A shingle at p is in the windows that start from p - (size - N) to p.
    ends = F.array(F.struct((F.col("p") - F.col("size") + N).alias("at"), F.col("w").alias("w")), F.struct((F.col("p") + 1).alias("at"), (-F.col("w")).alias("w")))
    by = Window.partitionBy("id", "text_hash", "item").orderBy("at")
    sums = met.select("id", "text_hash", "item", "size", "total", F.inline(ends)).withColumn("most", F.sum("w").over(by)).withColumn("next", F.lead("at").over(by))
    able = sums.where((F.col("next") > F.col("at")) & (F.col("most") * 10 >= F.col("total") * p.tenths))
    one = F.struct("size", F.col("at").alias("from"), (F.col("next") - 1).alias("to"), (F.col("most") * (10 + p.tenths) - F.col("total") * p.tenths).alias("room"))
    return able.groupBy("id", "text_hash").agg(F.collect_list(one).alias("ranges"))


def leaks(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, start_word, similarity: the best window for every document and item that match.
    text_hash (xxhash64 of the text) tells rows with a common or null id apart."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text")).withColumn("id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    items = benchmark.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") >= N)
    items = items.select("item_id", F.size("ws").alias("size"), "ws")
    starts = cut(ranges(docs, items, p))
    # Only texts with a window move: the others stay behind at the scan if the ids fit a broadcast.
    few = docs.dropna(subset=["text"]).join(_keys(starts.select("id", "text_hash"), p), ["id", "text_hash"], "left_semi")
    hit = few.join(starts, ["id", "text_hash"]).select("doc_id", "text_hash", words(F.col("text")).alias("ws"), "ranges")
    low, high = (lambda r: F.greatest(F.lit(0), r["from"])), (lambda r: F.least(r["to"], F.greatest(F.lit(0), F.size("ws") - r["size"])))
    inside = F.filter("ranges", lambda r: low(r) <= high(r))
    places = F.flatten(F.transform(inside, lambda r: F.transform(F.sequence(low(r), high(r)), lambda s: F.struct(r["size"].alias("size"), s.alias("start"), r["room"].alias("room")))))
    windows = hit.select("doc_id", "text_hash", "ws", F.inline(places)).select("doc_id", "text_hash", "size", "start", "room", shingle_texts(F.slice("ws", F.col("start") + 1, F.col("size"))).alias("shingles"))
    windows = windows.withColumn("weight", weight(F.col("shingles"))).where(F.col("weight") * p.tenths <= F.col("room")).drop("room")
    windows = windows.withColumn("print", simhash(F.col("shingles")))
    prints = items.select("item_id", "size", shingle_texts(F.col("ws")).alias("item_shingles")).withColumn("item_print", simhash(F.col("item_shingles"))).withColumn("item_weight", weight(F.col("item_shingles")))

    left = windows.withColumn("block", F.explode(blocks(F.col("print"), p.radius)))
    right = prints.withColumn("block", F.explode(blocks(F.col("item_print"), p.radius)))
    difference = F.col("print").bitwiseXOR(F.col("item_print"))
    # A pair meets in every block that agrees; the first one counts.
    near = left.join(right, ["size", "block"]).where((F.bit_count(difference) <= p.radius) & (F.col("block.k") == first_block(difference, p.radius)))
    near = near.select("doc_id", "text_hash", "item_id", "start", weight(F.array_intersect("shingles", "item_shingles")).alias("both"), (F.col("weight") + F.col("item_weight")).alias("sum"))
    found = near.withColumn("all", F.col("sum") - F.col("both")).where(F.col("both") * 10 >= F.col("all") * p.tenths)
    best = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct((F.col("both") / F.col("all")).alias("similarity"), (-F.col("start")).alias("start"))).alias("b"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("b.start")).cast("long").alias("start_word"), F.round("b.similarity", 6).alias("similarity"))


def _keys(found: DataFrame, p: Params) -> DataFrame:
    """The keys of a table, broadcast up to the bound."""
    return F.broadcast(found) if found.count() <= p.broadcast_keys else found


def clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns stay."""
    found = cut(leaks(docs, benchmark, p).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    same = (F.coalesce(docs["doc_id"], F.lit(-(1 << 63))) == found["__id"]) & (F.xxhash64(docs["text"].cast("string")) == found["__hash"])
    return docs.join(_keys(found, p), same, "left_anti")
