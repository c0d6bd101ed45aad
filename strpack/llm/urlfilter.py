"""URL rules, and exact membership of a long list of keys by a cascade of Bloom filters.

Level 1 encodes the listed keys that occur in the corpus; level 2 the unlisted keys of the corpus's complete key
universe that level 1 lets through; level 3 the listed ones that level 2 lets through; and so on until a level lets
nothing wrong through. Walking the levels is then exact for every key of the universe, with no join: the filters are
arrays of 64-bit words that a scalar subquery brings into the plan, a few bits for each listed key.

Everything is DataFrame operations: keys are hashed with xxhash64, words are built by bit_or in a grouped aggregate, and
probing is getbit on array elements. A level's words come in segments, each a subquery of its own, so that no array is
larger than SEGMENT whatever the list. With a quarter of the corpus's keys listed, all levels together take 6 to 7 bits a listed
key. The total is checked while building, since every executor holds it: up to ``most_bits`` (256 MiB, some 300 million
listed keys of the corpus) the cascade answers; what is larger than that is no broadcast any more, and an equi-join with the
listed keys gives the same answers.

Edge cases: a null url, or one without ``://``, has the empty host and path, which no rule fits and no list holds;
duplicate listed keys count once; repeated rows get equal verdicts; very long urls are read whole; an empty list or
universe lists nothing; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one segment of a level: 8 MiB.
SEGMENT = 1 << 20
#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits, or nulls. Rules are few and become one CASE, longest first."""
    text = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if text is None else (text, verdict)


@dataclass
class Level:
    bits: int
    hashes: int
    words: DataFrame  # (word BIGINT, bits BIGINT), only words that are not zero


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)
    #: Set where the cascade would be larger than allowed: the listed keys themselves.
    listed: DataFrame | None = None

    @property
    def bits(self) -> int:
        return sum(level.bits for level in self.levels)

    def flag(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with the boolean column ``name``: whether its key is listed. Exact for keys of the universe."""
        if self.listed is not None:
            listed = self.listed.select(F.col("key").alias("__key"), F.lit(True).alias(name))
            return df.join(listed, df[key] == listed["__key"], "left").drop("__key").fillna(False, [name])
        out = F.lit(len(self.levels) % 2 == 1)  # what passed every level belongs to the side that the last one encodes
        for i in reversed(range(len(self.levels))):
            out = F.when(~_passes(F.col(key), i, self.levels[i]), F.lit(i % 2 == 1)).otherwise(out)
        return df.withColumn(name, F.coalesce(out, F.lit(False)))


def _positions(key: Column, i: int, level_bits: int, hashes: int) -> list[Column]:
    """Double hashing, with seeds of the level's own."""
    a, b = F.pmod(F.xxhash64(F.lit(2 * i), key), F.lit(level_bits)), F.pmod(F.xxhash64(F.lit(2 * i + 1), key), F.lit(level_bits - 1)) + 1
    return [F.pmod(a + b * k, F.lit(level_bits)) for k in range(hashes)]


def _passes(key: Column, i: int, level: Level) -> Column:
    segments = [_packed(level, a).scalar() for a in range(0, level.bits // 64, SEGMENT)]
    out = F.lit(True)
    for p in _positions(key, i, level.bits, level.hashes):
        at = F.shiftright(p, 6)
        word = F.get(segments[0], at.cast("int"))
        for k, words in enumerate(segments[1:], 1):
            word = F.when(at >= k * SEGMENT, F.get(words, (at - k * SEGMENT).cast("int"))).otherwise(word)
        out = out & (F.getbit(word, F.pmod(p, F.lit(64)).cast("int")) == 1)
    return out


def _packed(level: Level, start: int) -> DataFrame:
    """One row: the words of a segment in order, zeros included."""
    spark, end = level.words.sparkSession, min(level.bits // 64, start + SEGMENT)
    every = spark.range(start, end, 1, 1).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    own = level.words.where((F.col("word") >= start) & (F.col("word") < end))
    dense = own.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def build(universe: DataFrame, listed: DataFrame, most_bits: int = 1 << 31, most_levels: int = 128) -> Cascade:
    """universe, listed: DataFrames with a column ``key``. The universe may repeat keys; it is reduced by a grouped
    aggregate (partial sums first, so hot keys cost nothing) and kept as a table while the levels are built."""
    both = universe.select("key", F.lit(0).alias("l"), F.lit(1).alias("u")).unionByName(listed.select("key", F.lit(1).alias("l"), F.lit(0).alias("u")))
    keys = cut(both.where("key IS NOT NULL").groupBy("key").agg(F.max("l").alias("l"), F.max("u").alias("u")).where("u = 1").select("key", (F.col("l") == 1).alias("listed")))
    yes = keys.where("listed").count()
    total, out, made = keys.count(), Cascade(), 0
    inside, outside = keys.where("listed").select("key"), keys.where("NOT listed").select("key")
    n, other, i, passed = yes, total - yes, 0, []
    while n:
        rate = min(0.5, max(1e-6, n / max(1, other) * 0.7)) if i == 0 else 0.5
        hashes = max(1, round(-math.log2(rate)))
        bits = max(128, -(-math.ceil(n * hashes / math.log(2)) // 64) * 64)
        made += bits
        if made > most_bits or i >= most_levels:
            for x in (*passed, *(level.words for level in out.levels)):
                drop_cut(x)
            return Cascade(listed=keys.where("listed").select("key"))
        at = F.explode(F.array(*_positions(F.col("key"), i, bits, hashes)))
        words = inside.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(p, 64) AS INT)))").alias("bits"))
        level = Level(bits, hashes, cut(words))
        out.levels.append(level)
        wrong = cut(outside.where(_passes(F.col("key"), i, level)))
        passed.append(wrong)
        inside, outside, n, other, i = wrong, inside, wrong.count(), n, i + 1
    for x in (keys, *passed):
        drop_cut(x)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", most_bits: int = 1 << 31) -> DataFrame:
    """key, host, path, rule, verdict: the longest fitting rule's verdict; where none fits, block if the host is listed."""
    host, path = host_path(F.col("url"))
    base = pages.select(F.col(key), F.col(url).alias("url")).select(key, host.alias("host"), path.alias("path"))
    cascade = build(base.select(F.col("host").alias("key")), listed, most_bits)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    out = cascade.flag(base.withColumns({"rule": rule, "__verdict": verdict}), "host", "__listed")
    return out.select(key, "host", "path", "rule", F.coalesce("__verdict", F.when(F.col("__listed"), "block").otherwise("allow")).alias("verdict"))
