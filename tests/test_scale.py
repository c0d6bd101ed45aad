"""Work and memory that must not grow with the table: lookups of a match, ranges, archives, batches."""

import pytest
from pyspark.sql import functions as F

from strpack.matching import Matcher, identity_tokens


class Counted(bytes):
    """Bytes that count how often they are looked at."""

    looks = 0

    def __getitem__(self, i):
        Counted.looks += 1
        return bytes.__getitem__(self, i)

    def startswith(self, *a):
        Counted.looks += 1
        return bytes.startswith(self, *a)


def test_a_match_takes_few_lookups_however_many_tokens_share_its_start():
    tokens = identity_tokens() + [b"Customer#%09d" % (i * 7) for i in range(20_000)] + [b"Customer#", b"Customer#00", b"Customer#0000"]
    m = Matcher(0, tokens)
    for row, want in ((b"Customer#000000007", [257]), (b"Customer#000000008", [len(tokens) - 1, 48, 48, 48, 48, 56]), (b"Customer#0", [len(tokens) - 3, 48])):
        Counted.looks = 0
        assert m.parse(Counted(row)) == want and Counted.looks < 100
        assert m.find(row, 0)[0] == want[0]


def test_the_longest_token_wins_at_every_length():
    texts = [b"abcdefgh" * 3 + b"xyz", b"abcdefghabcdefgh", b"abcdefghab", b"abcdefghabcdefghabcdefghx"]
    tokens = identity_tokens() + texts
    m = Matcher(0, tokens)
    for row in (b"abcdefgh" * 4, texts[0] + texts[2], texts[0][:-1], b"abcdefgh" * 2 + b"abc", b"abcdefgha"):
        at = 0
        while at < len(row):
            best = max((t for t in tokens if row.startswith(t, at)), key=len)
            assert m.find(row, at) == (tokens.index(best), len(best))
            at += len(best)
        assert b"".join(tokens[i] for i in m.parse(row)) == row


def test_ranges_are_found_by_halving(spark):
    """Same ranges as by counting the borders below a key, nulls and several columns included; few comparisons in the plan's data."""
    from strpack.operators import analytics

    df = spark.range(3000).select(F.when(F.col("id") % 10 > 0, F.col("id") * 17 % 500).alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    at = analytics.borders(df, ["a", "b"], 37)
    assert 30 <= len(at) <= 38
    key = lambda r: [(v is not None, v or 0 if not isinstance(v, str) else v) for v in r]
    for r in analytics.ranged(df, ["a", "b"], at=at).collect():
        assert r["__p"] == sum(key(x) < key((r.a, r.b)) for x in at)


def test_archives_are_bounded_whatever_the_group(spark, monkeypatch):
    """A large group comes in several archives of its key's ranges; small ones stay whole; no row is lost."""
    from strpack import archive
    from strpack.model import train

    monkeypatch.setattr(archive, "BLOB_ROWS", 100)
    df = spark.range(3000).select("id", F.when(F.col("id") % 50 > 1, "big").when(F.col("id") % 50 > 0, "small").alias("g"), F.format_string("user_%d", F.col("id") % 13).alias("v"))
    a = train(df, "v", ["id"]).encode(df, "v")
    blobs = a.to_blobs("id", ["g"]).cache()
    got = blobs.collect()
    assert max(r.n_rows for r in got) <= 100 and sum(r.g == "big" for r in got) < 90 and sum(r.g == "small" for r in got) == sum(r.g is None for r in got) == 1
    assert all(list(r["keys"]) == sorted(r["keys"]) for r in got)
    back = archive.from_blobs(blobs.select("g", "keys", "blob"), keys="keys").select(F.col("row").alias("id"), "g", F.col("value").alias("v"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    raw = sum(2 * len(t) + (1 if len(t) < 128 else 2) for t in (r.tokens for r in a.rows.collect()))
    assert sum(r.raw_bytes for r in got) == raw
    parts = a.to_blobs("id", most_rows=7).collect()
    assert max(r.n_rows for r in parts) == 7 and sum(r.n_rows for r in parts) == 3000 and len({r.part for r in parts}) == len(parts) < 480


def test_an_archive_is_bounded_by_its_ids_too(spark, monkeypatch):
    from strpack import archive
    from strpack.archive import Archive

    monkeypatch.setattr(archive, "BLOB_IDS", 50)
    rows = spark.createDataFrame([(i, [97] * n) for i, n in enumerate([30, 30, 20, 80, 1, 0, 49])], "k int, tokens array<int>")
    got = Archive(rows, tuple(identity_tokens())).to_blobs("k").collect()
    assert [list(r["keys"]) for r in got] == [[0], [1, 2], [3], [4, 5, 6]]


def test_batches_are_worked_off_in_pieces(monkeypatch):
    """Long rows and nulls: the same rows in the same order, and no piece much larger than its limit."""
    import numpy as np
    import pyarrow as pa

    from strpack.operators import codec

    weights = np.array([5, 0, 0, 30, 3, 3, 3, 3, 100, 0])
    runs = list(codec.pieces(weights, 10))
    assert [i for s, n in runs for i in range(s, s + n)] == list(range(10)) and all(n == 1 or weights[s : s + n].sum() <= 10 for s, n in runs)
    assert list(codec.pieces(np.array([], int))) == []
    rows = [[1, 2], None, [], [3], None]
    assert codec.listed(iter(rows)).equals(pa.array(rows, pa.list_(pa.int32()))) and codec.listed(iter([])).equals(pa.array([], pa.list_(pa.int32())))
    tokens = tuple(identity_tokens()) + (b"x" * 1000,)
    ids = pa.array([[7], [256, 1], [999], None, [], [256, 256]], pa.list_(pa.int32()))
    assert codec.decoded_sizes(ids, tokens).tolist() == [5, 1009, 4, 0, 0, 2008]
    assert codec.decoded_sizes(ids[1:2], tokens).tolist() == [1009]


def test_round_trip_in_small_pieces(spark, monkeypatch):
    """The piece a function sees is bounded although a batch has all rows."""
    from strpack.operators import codec

    df = spark.range(0, 400, 1, 1).select("id", F.when(F.col("id") % 9 > 0, F.repeat(F.lit("ab é"), (F.col("id") % 50).cast("int"))).alias("v"))
    seen = codec._mapped(df.withColumn("v", F.col("v").cast("binary")), "v", "n", "int", lambda c: __import__("pyarrow").array([len(c)] * len(c), "int32"), lambda c: codec.lengths(c) * 20_000)
    most = max(r.n for r in seen.collect())
    assert 1 <= most < 100
    tokens = identity_tokens() + [b"ab"]
    back = codec.decode(codec.encode(df, "v", tokens), tokens, out="v")
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]


def test_template_keys_split_off_the_first_fields_only(spark):
    from strpack.functions.templates import template_key, template_key_column, template_key_sql

    lines = [lead + " ".join(f"w{chr(97 + i)}" for i in range(n)) + tail for n in (0, 1, 11, 12, 13, 14, 40) for lead in ("", " ", "\t ") for tail in ("", " ", "  x")]
    df = spark.createDataFrame([(x,) for x in lines], "v string")
    for fields in (1, 12, 0):
        keys = df.select("v", template_key_column(F.col("v"), fields).alias("k"), F.expr(template_key_sql("v", fields)).alias("s"))
        assert all(r.k == r.s == template_key(r.v.encode(), fields).decode() for r in keys.collect())
    assert ", 14)" in df.select(template_key_column(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()


def test_the_hash_sample_of_repeated_keys_is_bounded_and_spread(spark, monkeypatch):
    """One key for all rows, or few equal rows: what is sorted stays near the budget, the sample near the table's mix."""
    from strpack.config import Config
    from strpack.operators import sampling

    sorted_rows = []
    real = sampling.byte_budget
    monkeypatch.setattr(sampling, "byte_budget", lambda pool, *a: sorted_rows.append(pool.count()) or real(pool, *a))
    one = spark.range(20_000).select(F.lit(7).alias("k"), F.format_string("name %05d", "id").alias("v"))
    few = spark.range(20_000).select(F.lit(7).alias("k"), F.element_at(F.array(F.lit("ab"), F.lit("cde"), F.lit("fghi")), (F.col("id") % 3 + 1).cast("int")).alias("v"))
    config = Config(sample_bytes=4000)
    got, _ = sampling.training_sample(one, "v", ["k"], config, "hash")
    assert len(got) == 400 == len(set(got)) and sum(v < b"name 10000" for v in got) < 300 and sorted_rows.pop() < 2000
    assert got == sampling.training_sample(one.repartition(5), "v", ["k"], config, "hash")[0]
    got, _ = sampling.training_sample(few, "v", ["k"], config, "hash")
    assert 4000 <= sum(map(len, got)) < 4004 and sorted_rows.pop() <= 3
    for df in (one, few):
        got, _ = sampling.training_sample(df, "v", ["k"], Config(sample_bytes=4000, stratified=True), "hash")
        assert 4000 <= sum(map(len, got)) < 4010 and got == sampling.training_sample(df.repartition(5), "v", ["k"], Config(sample_bytes=4000, stratified=True), "hash")[0]
    assert {v: got.count(v) > 400 for v in got} == {b"ab": True, b"cde": True, b"fghi": True}


def test_repeated_rows_end_with_the_budget():
    from strpack.operators.sampling import repeated

    assert repeated([(b"ab", 2), (b"", 1 << 60), (b"c", 1 << 60), (b"d", 1)], 6)[-2:] == [b"c", b"c"]
    assert repeated([(b"abc", 1), (b"de", 9)], 6) == [b"abc", b"de", b"de"] and repeated([], 5) == []


def test_the_stratified_hash_sample_has_its_share_of_other_templates(spark, monkeypatch):
    """Templates beyond the limit begin after all others in hash order; they get their quota, from one pass over the pool."""
    from strpack.config import Config
    from strpack.operators import sampling

    df = spark.range(5000).select("id", F.translate(F.format_string("kind %06d", "id"), "0123456789", "abcdefghij").alias("v"))
    order = [r.v.encode() for r in df.orderBy(F.pmod(F.xxhash64(F.lit(42), "id", F.col("v").cast("binary")), F.lit(sampling.SPACE))).collect()]
    passes, real = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: passes.append(1) or real(self))
    got, _ = sampling.training_sample(df, "v", ["id"], Config(stratified=True, sample_bytes=2000), "hash")
    assert sum(v in set(order[2048:]) for v in got) >= 100 and 2000 <= sum(map(len, got)) < 2011 and len(passes) == 1
