"""Operators on Spark: every catalogued query against its SQL, and the edges that tables of the benchmark lack."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strpack.archive import Archive, count_rows, dump, from_blobs, load_rows
from strpack.config import Config
from strpack.functions.templates import template_key, template_key_column
from strpack.model import Encoder, Model, train
from strpack.matching import Matcher
from strpack.operators import analytics, codec, encoded, grouped, sampling
from strpack.plans import catalog
from strpack.sources import archives
from strpack.training import train_rows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(repr([None if v is None or v != v else v for v in r]) for r in pdf[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_clashing_names_nulls_and_empties(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "", 6), (3, None, None), (None, "é\0x", 7)], "k int, v string, token_id int")
    a = train(df, "v", ["k"]).encode(df, "v")
    assert sorted(map(str, a.decode().collect())) == sorted(map(str, df.select("k", "v", "token_id").collect()))
    empty = df.where("false")
    model = train(empty, "v", ["k"])
    assert model.trained and len(model.tokens) == 256 and model.encode(empty, "v").decode().count() == 0
    assert model.encode(empty, "v").space_used().first().space_used == 256 + 257 * 4


def test_decode_errors(spark):
    df = spark.createDataFrame([(1, [97, 999])], "k int, tokens array<int>")
    tokens = tuple(bytes([i]) for i in range(256))
    with pytest.raises(Exception, match="token 1 has id 999"):
        codec.decode(df, tokens).collect()
    with pytest.raises(Exception, match="no token has id"):
        codec.decode_join(df, ["k"], codec.dictionary(spark, tokens)).collect()
    with pytest.raises(Exception, match="need 3 bytes, have 2"):
        codec.decode(spark.createDataFrame([(1, [97, 98, 99])], df.schema), tokens, capacity=2).collect()
    a = Archive(df, tokens)
    assert {r.check: r.n for r in a.violations().collect()}["unknown_id"] == 1
    with pytest.raises(IndexError):
        a.row(k=7)


def test_row_local_decoding(spark):
    """Rows that share a key stay rows of their own; null, empty and unknown ids; nothing is exchanged."""
    tokens = tuple(bytes([i]) for i in range(256)) + (b"ab",)
    df = spark.createDataFrame([(1, [256, 99]), (1, [256, 99]), (1, []), (None, None), (2, [0, 255])], "k int, tokens array<int>")
    plain = sorted(map(str, codec.decode(df, tokens, as_string=False).collect()))
    by_join = codec.decode_join(df, ["k"], codec.dictionary(spark, tokens))
    assert sorted(map(str, by_join.collect())) == plain
    sizes = codec.decoded_len_join(df, ["k"], codec.dictionary(spark, tokens))
    assert sorted((r.k or 0, -1 if r.decoded_len is None else r.decoded_len) for r in sizes.collect()) == [(0, -1), (1, 0), (1, 3), (1, 3), (2, 2)]
    for x in (by_join, sizes):
        assert "hashpartitioning" not in x._jdf.queryExecution().executedPlan().toString()
    gap = codec.dictionary(spark, tokens).where("token_id <> 5")
    with pytest.raises(Exception, match="gap"):
        codec.decode_join(df, ["k"], gap).collect()
    with pytest.raises(Exception, match="no token has id -1"):
        codec.decoded_len_join(spark.createDataFrame([(1, [-1])], df.schema), ["k"], codec.dictionary(spark, tokens)).collect()
    with pytest.raises(Exception, match="token 0 has id -1"):
        codec.decode(spark.createDataFrame([(1, [5]), (2, [-1])], df.schema).coalesce(1), tokens).collect()
    assert codec.decode(df.where("false"), tokens).count() == 0


def test_boundaries_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(analytics, "BORDER_SAMPLE", 50)
    df = spark.range(2000).select((F.col("id") * 7 % 2000).alias("k"), F.array_repeat(F.lit(1), (F.col("id") % 5).cast("int")).alias("tokens"))
    got = analytics.boundaries(df, ["k"]).orderBy("k").collect()
    total, sizes = 0, {r.k: r.n for r in df.select("k", F.size("tokens").alias("n")).collect()}
    for r in got:
        total += sizes[r.k]
        assert r.boundary == total
    assert len(got) == 2000
    steps = analytics.steps(analytics.boundaries(df, ["k"]), ["k"])
    assert {r.k: r.step for r in steps.collect()} == sizes
    assert analytics.summed(steps, ["k"], out="again").where("again <> boundary").count() == 0
    assert analytics.boundaries(df.where("false"), ["k"]).count() == 0


def test_point_lookups(spark, tmp_path):
    """By options of the data source only the wanted file is opened and only the wanted rows are decoded."""
    archives.register(spark)
    at = str(tmp_path / "files")
    df = spark.range(0, 3000, 1, 2).select(F.format_string("user_%06d", "id").alias("value"))
    df.write.format("strpack").mode("append").option("path", at).option("file_bytes", "5000").save()
    names = archives.listed(at)
    assert len(names) > 4 and not [n for n in os.listdir(at) if n.endswith(".tmp")]
    back = spark.read.format("strpack").option("path", "file://" + at).load()
    assert back.count() == 3000 and back.select(F.col("value").cast("string")).distinct().count() == 3000
    with open(names[0], "wb") as f:
        f.write(b"no archive")
    one = os.path.basename(names[1])
    some = lambda **options: spark.read.format("strpack").option("path", at).options(**options).load()
    assert [r.row for r in some(files=one, rows="5,3,1000000,3").collect()] == [3, 5] and some(files=one, rows="").count() == 0
    assert some(files=one).where("row < 4").count() == 4 and some(files=one).count() > 4 and some(files="none").count() == 0
    with pytest.raises(Exception, match="magic"):
        back.count()
    df.limit(3).coalesce(1).write.format("strpack").mode("overwrite").option("path", at).save()
    assert len(archives.listed(at)) == 1 and some().count() == 3
    rows = [b"a", b"bb", b"", b"dddd"]
    tokens = train_rows(rows, Config())
    blob = dump([Matcher(0, tokens).parse(r) for r in rows], tokens, 16)
    assert load_rows(blob, [3, 2]) == [b"dddd", b""] and count_rows(blob) == 4 and load_rows(blob, []) == []
    with pytest.raises(IndexError):
        load_rows(blob, [4])
    blobs = spark.createDataFrame([(1, bytearray(blob)), (2, bytearray(blob))], "g int, blob binary")
    assert sorted((r.g, r.row, r.value) for r in from_blobs(blobs, wanted=[1, 3, 9]).collect()) == [(g, k, rows[k].decode()) for g in (1, 2) for k in (1, 3)]


def test_stratified_sample_of_a_table(spark):
    """The sample of the documents against the plain rules, row by row, in training order."""
    docs = catalog.table(spark, SF, "documents")
    config = Config(stratified=True, sample_bytes=1 << 16)
    got, mode = sampling.training_sample(docs, "text", ["doc_id"], config, "exact")
    values = [r.text.encode() for r in docs.orderBy("doc_id").collect()]
    shuffled = [values[i] for i in sampling.permutation(len(values))]
    keys, sizes = [template_key(v) for v in shuffled], list(map(len, shuffled))
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(k if k in groups or len(groups) < config.clusters else "other", []).append(i)
    target = min(max(int(config.budget / (sum(sizes) / len(sizes))), 1), len(sizes))
    exact = [len(g) * target / len(values) for g in groups.values()]
    quota = [int(x) for x in exact]
    order = list(range(len(quota)))
    if left := target - sum(quota):
        order.sort(key=lambda c: -(exact[c] - quota[c]))
        for k in range(left):
            quota[order[k % len(order)]] += 1
    want, used, lists = [], 0, list(groups.values())
    for c in order:
        if used < config.budget or not want:
            want += lists[c][: quota[c]]
            used = sum(sizes[i] for i in want)
    turn = 1
    rest = {c: lists[c][quota[c] :] for c in order}
    while used < config.budget and any(rest.values()):
        for c in order:
            if rest[c] and used < config.budget:
                want.append(rest[c].pop(0))
                used += sizes[want[-1]]
        turn += 1
    assert mode == "exact" and got == [shuffled[i] for i in want]


def test_lifecycle_of_any_strings(spark):
    """Encoding twice gives the same ids, and strings that training never saw survive."""
    rng = random.Random(6)
    for options in ({}, {"max_token_length": 16}, {"max_token_id": 4095}, {"token_bits": 12}):
        a, b, q = ("".join(rng.choice("abé\x00 \t世") for _ in range(rng.randint(0, 40))) for _ in range(3))
        model = train(spark.createDataFrame(list(enumerate([a, b, a + b, a])), "k int, v string"), "v", ["k"], **options)
        df = spark.createDataFrame(list(enumerate([q, a, q + b, q, None])), "k int, v string")
        first, second = model.encode(df, "v"), model.encode(df, "v")
        assert sorted(map(str, first.rows.collect())) == sorted(map(str, second.rows.collect()))
        assert sorted(map(str, first.decode().collect())) == sorted(map(str, df.collect()))


def test_sampling_modes(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("INFO user="), F.col("id"), F.lit(" code="), F.col("id") % 7).alias("v"))
    for options in ({}, {"stratified": True, "max_clusters": 2}):
        config = Config(sample_bytes=2000, **options)
        for mode in ("exact", "hash"):
            got, used = sampling.training_sample(df, "v", ["id"], config, mode)
            assert used == mode and sum(map(len, got)) >= 2000 and sum(map(len, got[:-1])) < 2100
            assert got == sampling.training_sample(df.repartition(7), "v", ["id"], config, mode)[0]
    exact, _ = sampling.training_sample(df, "v", ["id"], Config(sample_bytes=2000))
    values = [r.v.encode() for r in df.orderBy("id").collect()]
    order = sampling.permutation(3000)
    shuffled = [values[i] for i in order]
    assert exact == shuffled[: sampling.budget_prefix(list(map(len, shuffled)), 2000)]


def test_template_column_is_the_python_one(spark):
    lines = ["", "  ", "[x] a=1.2.3.4, B=beef-BEEF-99 (12:30)", "k==v == =", "ünï 'q' \"z\";", "a b\u0085c", "y" * 50, "1.2.3.4.5 00001.2.3.255 1- -- ..5", "deadbeef DEADBEEF- abcdefg1"]
    df = spark.createDataFrame([(x,) for x in lines], "v string").select("v", template_key_column(F.col("v")).alias("k"))
    for r in df.collect():
        assert r.k.encode() == template_key(r.v.encode()), r.v


def test_persistence_and_blobs(spark, tmp_path):
    df = spark.createDataFrame([(i, f"user_{i:06d}") for i in range(100)], "k int, v string")
    a = Encoder(Config(token_bits=12)).encode(df, "v", ["k"])
    a.save(str(tmp_path / "a"))
    b = Archive.load(spark, str(tmp_path / "a"))
    assert b.bits == 12 and b.row(k=42) == b"user_000042"
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,7)]" in b.decode("k = 7")._jdf.queryExecution().toString()
    model = Model(Config(), a.dictionary)
    model.save(spark, str(tmp_path / "m"))
    assert Model.load(spark, str(tmp_path / "m")) == model
    several = a.to_blobs("k", most_rows=20).collect()
    assert 4 <= len(several) <= 6 and sum(r.n_rows for r in several) == 100 and max(r.n_rows for r in several) <= 26
    blob = a.to_blobs("k").collect()
    assert len(blob) == 1 and blob[0].n_rows == 100
    back = from_blobs(spark.createDataFrame(blob, a.to_blobs("k").schema).select("keys", "blob"), keys="keys")
    assert {r.row: r.value for r in back.collect()} == {i: f"user_{i:06d}" for i in range(100)}
    total = sum(len(f"user_{i:06d}") for i in range(100))
    assert len(a.decompress_all(["k"], total)) == total
    with pytest.raises(ValueError, match="have 5"):
        a.decompress_all(["k"], 5)


def test_groups_and_encoded_values(spark):
    df = spark.createDataFrame([(i, ["x", "y", None][i % 3], f"{['x', 'y', 'n'][i % 3]}-{i % 4}") for i in range(60)], "k int, g string, v string")
    d = grouped.group_dictionaries(df, "g", "v", ["k"])
    assert d.count() == 3 and len(grouped.collected(d, "g")) == 3
    once = grouped.collected(d, "g")
    assert grouped.decode_grouped(grouped.encode_grouped(df, once, "g", "v"), once, "g", out="v").count() == 60
    back = grouped.decode_grouped(grouped.encode_grouped(df, d, "g", "v"), d, "g", out="v")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    model = train(df, "v", ["k"])
    a = model.encode(df.select("k", "v"), "v")
    assert encoded.where_equals(a, model, "x-0").decode().count() == df.where("v = 'x-0'").count()
    assert encoded.distinct_values(a).count() == df.select("v").distinct().count()
    with pytest.raises(ValueError):
        encoded.join(a, train(df, "g", ["k"]).encode(df.select("k", "g"), "g"))
