"""Queries (spark, sf_dir) -> DataFrame over the benchmark tables, and SQL that gives the same rows.

Round-trip queries really train, encode and decode. Where values depend on a dictionary, queries use the identity model
(max_token_id=255: tokens are bytes), whose ids SQL can say; trained models appear where results do not depend on ids.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import archive as archives
from .. import streaming
from ..archive import Archive
from ..config import Config
from ..functions.registration import register
from ..functions import templates
from ..functions.templates import template_key_column
from ..model import Encoder, Model, train
from ..operators import analytics, codec, encoded, grouped, sampling
from ..sources import archives as archive_source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
IDENTITY = {"max_token_id": 255}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trained(spark: SparkSession, d: str, name: str, value: str, *key: str, **options) -> Archive:
    df = table(spark, d, name).select(*key, value)
    return Encoder(Config(**options)).encode(df, value, key)


def _round_trip(label: str, name: str, value: str, *key: str, **options) -> None:
    columns = ", ".join((*key, value))
    query(label, f"SELECT {columns} FROM {name}")(lambda spark, d: trained(spark, d, name, value, *key, **options).decode())


_round_trip("roundtrip_customer", "customer", "c_name", "c_custkey")
_round_trip("roundtrip_part", "part", "p_name", "p_partkey")
_round_trip("roundtrip_url", "pages", "url", "page_id")
_round_trip("roundtrip_props", "events", "props", "event_id")
_round_trip("roundtrip_priority", "orders", "o_orderpriority", "o_orderkey")
_round_trip("roundtrip_conversation", "conversations", "text", "conv_id", "turn")
_round_trip("roundtrip_document", "documents", "text", "doc_id")
_round_trip("roundtrip_document_stratified", "documents", "text", "doc_id", stratified=True)
_round_trip("roundtrip_maxlen16", "customer", "c_name", "c_custkey", max_token_length=16)
_round_trip("roundtrip_threshold10", "customer", "c_name", "c_custkey", threshold=10)
_round_trip("roundtrip_maxid4095", "events", "props", "event_id", max_token_id=4095)
_round_trip("roundtrip_bits12", "pages", "url", "page_id", token_bits=12)


@query("roundtrip_hash_sample", "SELECT doc_id, text FROM documents")
def roundtrip_hash_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return train(docs, "text", ["doc_id"], mode="hash", sample_bytes=1 << 18).encode(docs, "text").decode()


@query("roundtrip_batch_trainer", "SELECT p_partkey, p_name FROM part")
def roundtrip_batch_trainer(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    tokens = grouped.batch_dictionary(part, "p_name", ["p_partkey"], rounds=3)
    return codec.decode(codec.encode(part, "p_name", tokens), tokens, out="p_name")


@query("model_reuse", "SELECT p_partkey, p_name FROM part")
def model_reuse(spark, d):
    model = train(table(spark, d, "orders"), "o_orderpriority", ["o_orderkey"])
    return model.encode(table(spark, d, "part").select("p_partkey", "p_name"), "p_name").decode()


@query("per_group_models", "SELECT doc_id, lang, text FROM documents")
def per_group_models(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    config = Config(sample_bytes=1 << 16)
    dictionaries = grouped.collected(grouped.group_dictionaries(docs, "lang", "text", ["doc_id"], config), "lang")
    ids = grouped.encode_grouped(docs, dictionaries, "lang", "text", config)
    return grouped.decode_grouped(ids, dictionaries, "lang", out="text")


@query("decode_join", "SELECT c_custkey, c_name FROM customer")
def decode_join(spark, d):
    a = trained(spark, d, "customer", "c_name", "c_custkey")
    return codec.decode_join(a.rows, ["c_custkey"], a.dictionary_df(), out="c_name").withColumn("c_name", F.col("c_name").cast("string"))


@query("decoded_len", "SELECT c_custkey, CAST(strlen(c_name) AS BIGINT) AS decoded_len FROM customer")
def decoded_len(spark, d):
    return trained(spark, d, "customer", "c_name", "c_custkey").decoded_len()


_TWICE = "(SELECT * FROM customer UNION ALL SELECT * FROM customer)"


def _repeated(spark, d) -> Archive:
    """Customers twice, filed under their nation: keys repeat, with equal and with other values."""
    a = trained(spark, d, "customer", "c_name", "c_nationkey")
    return Archive(a.rows.unionAll(a.rows), a.dictionary, a.bits)


@query("decoded_len_repeated", f"SELECT c_nationkey, CAST(strlen(c_name) AS BIGINT) AS decoded_len FROM {_TWICE}")
def decoded_len_repeated(spark, d):
    return _repeated(spark, d).decoded_len()


@query("decode_join_repeated", f"SELECT c_nationkey, c_name FROM {_TWICE}")
def decode_join_repeated(spark, d):
    a = _repeated(spark, d)
    return codec.decode_join(a.rows, ["c_nationkey"], a.dictionary_df(), out="c_name").withColumn("c_name", F.col("c_name").cast("string"))


@query("decoded_len_documents", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS decoded_len FROM documents")
def decoded_len_documents(spark, d):
    return trained(spark, d, "documents", "text", "doc_id").decoded_len()


@query("rows_count", "SELECT count(*) AS row_count FROM customer")
def rows_count(spark, d):
    return trained(spark, d, "customer", "c_name", "c_custkey").count()


@query("random_access", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (7, 42, 99)")
def random_access(spark, d):
    return trained(spark, d, "customer", "c_name", "c_custkey").decode(F.col("c_custkey").isin(7, 42, 99))


@query("bounded_decode", "SELECT c_custkey, c_name FROM customer")
def bounded_decode(spark, d):
    return trained(spark, d, "customer", "c_name", "c_custkey").decode(capacity=18)


@query("append_all", "SELECT o_orderstatus, string_agg(o_orderpriority, '' ORDER BY o_orderkey) AS blob FROM orders GROUP BY o_orderstatus")
def append_all(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    a = train(orders, "o_orderpriority", ["o_orderkey"]).encode(orders, "o_orderpriority")
    return a.append_all(["o_orderkey"], ["o_orderstatus"]).withColumn("blob", F.col("blob").cast("string"))


def _identity(spark, d, name, value, *key, **options) -> Archive:
    return trained(spark, d, name, value, *key, **IDENTITY, **options)


_BYTES = "SELECT page_id, i - 1 AS pos, ascii(substr(url, i, 1)) AS token_id FROM (SELECT page_id, url, unnest(range(1, strlen(url) + 1)) AS i FROM pages)"


@query("token_ids_url", f"SELECT page_id, CAST(pos AS INTEGER) AS pos, CAST(token_id AS INTEGER) AS token_id FROM ({_BYTES})")
def token_ids_url(spark, d):
    return _identity(spark, d, "pages", "url", "page_id").rows.select("page_id", F.posexplode("tokens").alias("pos", "token_id"))


_HISTOGRAM = f"SELECT token_id, count(*) AS n FROM ({_BYTES}) GROUP BY token_id"


@query("token_histogram", f"SELECT CAST(token_id AS INTEGER) AS token_id, n FROM ({_HISTOGRAM})")
def token_histogram(spark, d):
    return analytics.histogram(_identity(spark, d, "pages", "url", "page_id").rows)


_BOOK = f"SELECT CAST(row_number() OVER (ORDER BY n DESC, token_id) - 1 AS INTEGER) AS code, CAST(token_id AS INTEGER) AS token_id, n FROM ({_HISTOGRAM})"


@query("codebook_top255", f"SELECT * FROM ({_BOOK}) WHERE code < 255")
def codebook_top255(spark, d):
    return analytics.codebook(_identity(spark, d, "pages", "url", "page_id").rows)


@query("codebook_top10", f"SELECT * FROM ({_BOOK}) WHERE code < 10")
def codebook_top10(spark, d):
    return analytics.codebook(_identity(spark, d, "pages", "url", "page_id").rows, 10)


@query("codebook_payload_size", f"SELECT CAST(6 + sum(CASE WHEN code < 255 THEN 2 + n ELSE 3 * n END) AS BIGINT) AS payload_bytes FROM ({_BOOK})")
def codebook_payload_size(spark, d):
    return analytics.codebook_payload_size(_identity(spark, d, "pages", "url", "page_id").rows)


@query("string_boundaries", "SELECT c_custkey, CAST(sum(strlen(c_name)) OVER (ORDER BY c_custkey) AS BIGINT) AS boundary FROM customer")
def string_boundaries(spark, d):
    a = _identity(spark, d, "customer", "c_name", "c_custkey")
    return analytics.boundaries(a.rows, ["c_custkey"], at=analytics.borders(a.source, ["c_custkey"]))


@query("boundary_delta_roundtrip", "SELECT CAST(0 AS BIGINT) AS mismatches, count(*) AS n FROM customer")
def boundary_delta_roundtrip(spark, d):
    """Row boundaries of trained ids, taken apart into steps and summed up again. Sizes and boundaries are stored first:
    each operator reads its rows twice, and nothing is encoded or summed again for that. All share their ranges."""
    a, key, at = trained(spark, d, "customer", "c_name", "c_custkey"), ["c_custkey"], _scratch(spark)
    borders = analytics.borders(a.source, key)
    a.rows.write.parquet(f"{at}/rows")
    analytics.boundaries(spark.read.parquet(f"{at}/rows"), key, at=borders).write.parquet(f"{at}/boundaries")
    b = analytics.steps(spark.read.parquet(f"{at}/boundaries"), key, at=borders)
    back = analytics.summed(b, key, out="again", at=borders)
    return back.agg(F.count_if(F.col("again") != F.col("boundary")).alias("mismatches"), F.count("*").alias("n"))


@query(
    "boundary_varint_bytes",
    "SELECT 8 * (count(*) + 1) + 4 AS absolute_bytes, CAST(16 + sum(CASE WHEN strlen(text) < 128 THEN 1 WHEN strlen(text) < 16384 THEN 2 WHEN strlen(text) < 2097152 THEN 3 ELSE 4 END) AS BIGINT) AS delta_bytes FROM documents",
)
def boundary_varint_bytes(spark, d):
    return analytics.boundary_bytes(_identity(spark, d, "documents", "text", "doc_id").rows)


_N = "(SELECT CAST(sum(strlen(c_name)) AS BIGINT) AS n, count(*) AS r FROM customer)"


@query("space_used_16", f"SELECT 2 * n + 256 + 257 * 4 AS space_used, 2 * n + 256 + 257 * 4 + 8 * (r + 1) AS full_in_memory FROM {_N}")
def space_used_16(spark, d):
    return _identity(spark, d, "customer", "c_name", "c_custkey").space_used()


@query("space_used_12", f"SELECT (n * 12 + 7) // 8 + 256 + 257 * 4 AS space_used, (n * 12 + 7) // 8 + 256 + 257 * 4 + 8 * (r + 1) AS full_in_memory FROM {_N}")
def space_used_12(spark, d):
    return _identity(spark, d, "customer", "c_name", "c_custkey", token_bits=12).space_used()


@query("stream_sizes", f"SELECT n AS n_tokens, 4 + 2 * n AS raw16_bytes, 4 + (n * 12 + 7) // 8 AS packed12_bytes FROM {_N}")
def stream_sizes(spark, d):
    return analytics.stream_sizes(_identity(spark, d, "customer", "c_name", "c_custkey").rows)


@query("dictionary_identity", "SELECT CAST(i AS INTEGER) AS token_id, printf('%02X', i) AS token, 1 AS token_len FROM range(256) AS t(i)")
def dictionary_identity(spark, d):
    a = trained(spark, d, "customer", "c_name", "c_custkey")
    return a.dictionary_df().where("token_id < 256").select("token_id", F.hex("token").alias("token"), "token_len")


@query("archive_violations", "SELECT unnest(['unknown_id', 'id_too_wide', 'dictionary_gap', 'empty_token', 'identity_token']) AS \"check\", CAST(0 AS BIGINT) AS n")
def archive_violations(spark, d):
    return trained(spark, d, "customer", "c_name", "c_custkey").violations()


@query(
    "lcg_permutation",
    "WITH RECURSIVE s(i, state) AS (SELECT 999, (CAST(42 AS HUGEINT) * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 UNION ALL SELECT i - 1, (state * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 FROM s WHERE i > 1) SELECT CAST(i AS INTEGER) AS i, CAST(state % (i + 1) AS INTEGER) AS j FROM s",
)
def lcg_permutation(spark, d):
    """The swaps behind the permutation of 1000 ordinals, recovered from the permutation itself."""
    target, now, swaps = sampling.permutation(1000), list(range(1000)), []
    for i in range(999, 0, -1):  # once i is reached, its value never moves again
        j = now.index(target[i])
        now[i], now[j] = now[j], now[i]
        swaps.append((i, j))
    return spark.createDataFrame(swaps, "i int, j int")


@query(
    "byte_budget_sample",
    "SELECT c_custkey FROM (SELECT c_custkey, sum(strlen(c_name)) OVER (ORDER BY c_custkey) - strlen(c_name) AS before FROM customer) WHERE before < 5000",
)
def byte_budget_sample(spark, d):
    return sampling.byte_budget(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", ["c_custkey"], 5000).select("c_custkey")


_OCTET = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_UPLOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _value_sql(v: str) -> str:
    return f"""CASE WHEN regexp_full_match({v}, '{_OCTET}(\\.{_OCTET}){{3}}') THEN '<IP>'
  WHEN regexp_full_match({v}, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') THEN '<UUID>'
  WHEN regexp_full_match({v}, '[0-9a-fA-F-]+') AND length(regexp_replace({v}, '-', '', 'g')) >= 8 THEN '<HEX>'
  WHEN regexp_full_match({v}, '[0-9.,_:/+-]+') AND length(regexp_replace({v}, '[^0-9]', '', 'g')) * 2 >= length({v}) AND regexp_matches({v}, '[0-9]') THEN '<NUM>'
  ELSE translate(substr({v}, 1, 32), {_UPLOW}) END"""


def _key_sql(column: str) -> str:
    trim = "regexp_replace(regexp_replace(f, '^[][(){}<>,;:''\"]+', ''), '[][(){}<>,;:''\"]+$', '')"
    field = f"CASE WHEN t = '' THEN '<*>' WHEN strpos(t, '=') > 1 AND strpos(t, '=') < length(t) THEN translate(substr(t, 1, strpos(t, '=')), {_UPLOW}) || {_value_sql('substr(t, strpos(t, chr(61)) + 1)')} ELSE {_value_sql('t')} END"
    parts = f"list_filter(string_split_regex({column}, '\\s+'), lambda f: f <> '')[1:12]"
    return f"array_to_string(list_transform(list_transform({parts}, lambda f: {trim}), lambda t: {field}), ' ')"


def _template(label: str, name: str, value: str, key: str) -> None:
    query(label, f"SELECT {key}, {_key_sql(value)} AS template FROM {name}")(lambda spark, d: table(spark, d, name).select(key, template_key_column(F.col(value)).alias("template")))


_template("template_key_props", "events", "props", "event_id")
_template("template_key_url", "pages", "url", "page_id")
_template("template_key_priority", "orders", "o_orderpriority", "o_orderkey")
_LINES = "SELECT event_id, '[' || CAST(ts AS DATE) || '] user=' || user_id || ' (' || event_type || ') 10.0.' || (user_id % 256) || '.1 ' || props AS line FROM events"


@query("template_key_lines", f"SELECT event_id, {_key_sql('line')} AS template FROM ({_LINES})")
def template_key_lines(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.lit("["), F.col("ts").cast("date").cast("string"), F.lit("] user="), F.col("user_id").cast("string"), F.lit(" ("), "event_type", F.lit(") 10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1 "), "props")
    return e.select("event_id", template_key_column(line).alias("template"))


_FIELDS = ("1.2.3.4", "1.2.3.256", "0001.002.3.4", "1.2.3", "550e8400-e29b-41d4-a716-446655440000", "550e8400e29b", "2025-09-12", "12:30", "1--", "1-", "[x]", "'ABC';", "deadbee", "DEADBEEF", "a=b", "..", "<>", "99%")


@query(
    "template_predicates",
    "SELECT f, "
    f"regexp_full_match(f, '{_OCTET}(\\.{_OCTET}){{3}}') AS ipv4, regexp_full_match(f, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') AS uuid, "
    "regexp_full_match(f, '[0-9a-fA-F-]+') AND length(replace(f, '-', '')) >= 8 AS hex, "
    "regexp_full_match(f, '[0-9.,_:/+-]+') AND regexp_matches(f, '[0-9]') AND length(regexp_replace(f, '[^0-9]', '', 'g')) * 2 >= length(f) AS number, "
    f"translate(trim(f, '[](){{}}<>,;:''\"'), {_UPLOW}) AS plain FROM (VALUES " + ", ".join("('" + f.replace("'", "''") + "')" for f in _FIELDS) + ") AS t(f)",
)
def template_predicates(spark, d):
    f = F.col("f")
    tests = {"ipv4": templates.looks_ipv4, "uuid": templates.looks_uuid, "hex": templates.looks_hex, "number": templates.looks_number}
    rows = spark.createDataFrame([(x,) for x in _FIELDS], "f string")
    return rows.select("f", *[t(f).alias(n) for n, t in tests.items()], templates.lower_ascii(templates.trimmed(f)).alias("plain"))


_CLUSTERS = f"SELECT {_key_sql('o_orderpriority')} AS k, min(o_orderkey) AS first, count(*) AS n FROM orders GROUP BY k"


@query("template_cluster_counts", f"SELECT k AS template, n FROM ({_CLUSTERS})")
def template_cluster_counts(spark, d):
    return table(spark, d, "orders").groupBy(template_key_column(F.col("o_orderpriority")).alias("template")).agg(F.count("*").alias("n"))


@query("template_top_clusters", f"SELECT k AS template, n FROM ({_CLUSTERS}) ORDER BY n DESC, k LIMIT 3")
def template_top_clusters(spark, d):
    return template_cluster_counts(spark, d).orderBy(F.desc("n"), "template").limit(3)


@query(
    "stratified_quota",
    f"WITH c AS ({_CLUSTERS}), o AS (SELECT *, row_number() OVER (ORDER BY first) AS r FROM c), g AS (SELECT CASE WHEN r <= 3 THEN k ELSE '__template_other__' END AS cluster, min(first) AS first, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY 1), "
    "e AS (SELECT *, CAST(n AS DOUBLE) * 1000 / (SELECT sum(n) FROM g) AS x FROM g), f AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, first) AS p, 1000 - (SELECT sum(floor(x)) FROM e) AS l FROM e) "
    "SELECT cluster, n, CAST(floor(x) + CASE WHEN p <= l THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f",
)
def stratified_quota(spark, d):
    rows = table(spark, d, "orders").select(template_key_column(F.col("o_orderpriority")).alias("k"), F.col("o_orderkey").alias("seq"))
    return sampling.stratified_quotas(rows, "k", "seq", 1000, 3)


@query("stratified_sample")
def stratified_sample(spark, d):
    """The stratified training sample of the documents, in training order (no SQL: the order is a seeded shuffle)."""
    docs = table(spark, d, "documents")
    rows, _ = sampling.training_sample(docs, "text", ["doc_id"], Config(stratified=True, sample_bytes=1 << 16))
    return spark.createDataFrame([(i, len(r)) for i, r in enumerate(rows)], "seq int, bytes int")


def _priorities(spark, d):
    a = trained(spark, d, "orders", "o_orderpriority", "o_orderkey")
    return a, Model(Config(), a.dictionary, "exact")


@query("group_by_on_tokens", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def group_by_on_tokens(spark, d):
    return encoded.group_by_value(_priorities(spark, d)[0])


@query("distinct_on_tokens", "SELECT DISTINCT p_name FROM part")
def distinct_on_tokens(spark, d):
    return encoded.distinct_values(trained(spark, d, "part", "p_name", "p_partkey"))


@query("equality_on_tokens", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)")
def equality_on_tokens(spark, d):
    a, model = _priorities(spark, d)
    wanted = table(spark, d, "orders").agg(F.min("o_orderpriority")).first()[0]
    return encoded.where_equals(a, model, wanted).decode()


@query("in_on_tokens", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW', 'none')")
def in_on_tokens(spark, d):
    a, model = _priorities(spark, d)
    return encoded.where_equals(a, model, "1-URGENT", "5-LOW", "none").decode()


@query("equi_join_on_tokens", "SELECT a.n_nationkey, b.r_regionkey FROM nation a JOIN (SELECT r_regionkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey) b ON a.n_name = b.n_name")
def equi_join_on_tokens(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    model = train(nation, "n_name", ["n_nationkey"])
    left = model.encode(nation.select("n_nationkey", "n_name"), "n_name")
    right = model.encode(region.join(nation, region.r_regionkey == nation.n_regionkey).select("r_regionkey", "n_name"), "n_name")
    return encoded.join(left, right, right_columns=["r_regionkey"]).select("n_nationkey", "r_regionkey")


@query("wire_roundtrip", "SELECT o_orderstatus, o_orderkey, o_orderpriority FROM orders")
def wire_roundtrip(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    blobs = train(orders, "o_orderpriority", ["o_orderkey"]).encode(orders, "o_orderpriority").to_blobs("o_orderkey", ["o_orderstatus"])
    back = archives.from_blobs(blobs.select("o_orderstatus", "keys", "blob"), keys="keys")
    return back.select("o_orderstatus", F.col("row").alias("o_orderkey"), F.col("value").alias("o_orderpriority"))


@query("wire_roundtrip_bits12", "SELECT n_nationkey, n_name FROM nation")
def wire_roundtrip_bits12(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    blobs = train(nation, "n_name", ["n_nationkey"], token_bits=12).encode(nation, "n_name").to_blobs("n_nationkey")
    return archives.from_blobs(blobs.select("keys", "blob"), keys="keys").select(F.col("row").alias("n_nationkey"), F.col("value").alias("n_name"))


@query("wire_split", "SELECT o_orderkey, o_orderpriority FROM orders")
def wire_split(spark, d):
    """A table without groups in many archives, by its key."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    blobs = train(orders, "o_orderpriority", ["o_orderkey"]).encode(orders, "o_orderpriority").to_blobs("o_orderkey", most_rows=500)
    back = archives.from_blobs(blobs.select("keys", "blob"), keys="keys")
    return back.select(F.col("row").alias("o_orderkey"), F.col("value").alias("o_orderpriority"))


@query("wire_candidate_min", "SELECT DISTINCT o_orderstatus, CAST(0 AS BIGINT) AS larger_than_raw FROM orders")
def wire_candidate_min(spark, d):
    """How many archives are larger than their ids raw, dictionary, boundaries and frames would be."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    a = train(orders, "o_orderpriority", ["o_orderkey"]).encode(orders, "o_orderpriority")
    fixed = sum(map(len, a.dictionary)) + 4 * (len(a.dictionary) + 1) + 200
    sizes = a.to_blobs("o_orderkey", ["o_orderstatus"]).select("o_orderstatus", "n_bytes", "raw_bytes")
    return sizes.groupBy("o_orderstatus").agg(F.count_if(F.col("n_bytes") > F.col("raw_bytes") + fixed).alias("larger_than_raw"))


def _scratch(spark: SparkSession) -> str:
    """A folder all executors see: the session's checkpoint folder, a local one only where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return tempfile.mkdtemp(prefix="strpack-") if not at else f"{at.rstrip('/')}/{next(tempfile._get_candidate_names())}"


@query("archive_files", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name")
def archive_files(spark, d):
    """Written through the data source, read back through it."""
    archive_source.register(spark)
    at = _scratch(spark).removeprefix("file://").removeprefix("file:")
    table(spark, d, "part").select(F.col("p_name").alias("value")).write.format("strpack").mode("append").option("path", at).save()
    back = spark.read.format("strpack").option("path", at).load()
    return back.groupBy(F.col("value").cast("string").alias("p_name")).agg(F.count("*").alias("n"))


@query("archive_parquet", "SELECT c_custkey, c_name FROM customer")
def archive_parquet(spark, d):
    """Rows and dictionary persisted as Parquet, loaded again and decoded in full."""
    at = _scratch(spark)
    a = trained(spark, d, "customer", "c_name", "c_custkey")
    Archive(a.rows.sort("c_custkey"), a.dictionary, a.bits).save(at)
    return Archive.load(spark, at).decode().withColumnRenamed("value", "c_name")


@query("archive_point_lookup", "SELECT 0 AS \"row\", min(p_name) AS p_name FROM part UNION ALL SELECT 1, (SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 1 OFFSET 1)")
def archive_point_lookup(spark, d):
    """Two rows of an archive file, by the data source's option: nothing else is decoded."""
    archive_source.register(spark)
    at = _scratch(spark).removeprefix("file://").removeprefix("file:")
    names = table(spark, d, "part").select(F.col("p_name").alias("value")).distinct().coalesce(1).sortWithinPartitions("value")
    names.write.format("strpack").mode("append").option("path", at).save()
    back = spark.read.format("strpack").option("path", at).option("rows", "0,1").load()
    return back.select(F.col("row").cast("int").alias("row"), F.col("value").cast("string").alias("p_name"))


@query("blob_point_lookup", "SELECT o_orderstatus, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_orderstatus")
def blob_point_lookup(spark, d):
    """The first order of each status out of serialized archives, by key."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    blobs = train(orders, "o_orderpriority", ["o_orderkey"]).encode(orders, "o_orderpriority").to_blobs("o_orderkey", ["o_orderstatus"])
    first = [r.k for r in orders.groupBy("o_orderstatus").agg(F.min("o_orderkey").alias("k")).collect()]
    back = archives.from_blobs(blobs.select("o_orderstatus", "keys", "blob"), keys="keys", wanted=first)
    return back.select("o_orderstatus", F.col("row").alias("o_orderkey"), F.col("value").alias("o_orderpriority"))


@query("line_scan", "SELECT value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) GROUP BY value")
def line_scan(spark, d):
    """Documents written as text and read line by line."""
    at = _scratch(spark)
    table(spark, d, "documents").select("text").write.text(at)
    return archive_source.read_lines(spark, at).groupBy("value").agg(F.count("*").alias("n"))


@query("stream_encode", "SELECT event_id, props FROM events")
def stream_encode(spark, d):
    events = table(spark, d, "events").select("event_id", "props")
    model, at = train(events, "props", ["event_id"]), _scratch(spark)
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).select("event_id", "props")
    streaming.write_encoded(stream, "props", model, f"{at}/out", f"{at}/state").awaitTermination()
    return codec.decode(spark.read.parquet(f"{at}/out"), model.tokens, out="props")


@query("sql_functions", "SELECT n_nationkey, n_name, CAST(strlen(n_name) AS BIGINT) AS decoded_len FROM nation")
def sql_functions(spark, d):
    nation = table(spark, d, "nation")
    register(spark, train(nation, "n_name", ["n_nationkey"]), "sp_")
    nation.createOrReplaceTempView("strpack_nation")
    return spark.sql("SELECT n_nationkey, sp_decode(sp_encode(n_name)) AS n_name, sp_decoded_len(sp_encode(n_name)) AS decoded_len FROM strpack_nation")


@query("sql_token_stream", "SELECT r_regionkey, CAST(strlen(r_name) AS BIGINT) AS bytes FROM region")
def sql_token_stream(spark, d):
    region = table(spark, d, "region")
    register(spark, train(region, "r_name", ["r_regionkey"]), "sp_")
    region.createOrReplaceTempView("strpack_region")
    return spark.sql("SELECT r_regionkey, CAST(sum(octet_length(token)) AS BIGINT) AS bytes FROM strpack_region, LATERAL sp_token_stream(r_name) GROUP BY r_regionkey")


@query("sql_template_key", f"SELECT event_id, {_key_sql('props')} AS template FROM events")
def sql_template_key(spark, d):
    """Template keys by the SQL function, whose body is an expression: no Python runs."""
    events = table(spark, d, "events")
    register(spark, Model(tokens=tuple(bytes([i]) for i in range(256))), "sp_")
    events.createOrReplaceTempView("strpack_events")
    return spark.sql("SELECT event_id, sp_template_key(props) AS template FROM strpack_events")


#: (case, rows, options, ids of each row): what the trainer and the parser give, worked out by hand.
_GOLDENS = (
    ("pair", ("aaaa",), {}, ((256, 256),)),
    ("pair_12", ("aaaa",), {"token_bits": 12}, ((256, 256),)),
    ("no_new_ids", ("aaaa",), {"max_token_id": 255}, ((97, 97, 97, 97),)),
    ("threshold_3", ("aaaa",), {"threshold": 3}, ((256, 256),)),
    ("threshold_1", ("ab",), {"threshold": 1}, ((256,),)),
    ("twice", ("abab",), {}, ((256, 256),)),
    ("longer", ("ab" * 6,), {}, ((257, 257, 257),)),
    ("longest_3", ("ab" * 6,), {"max_token_length": 3}, ((256,) * 6,)),
    ("one_new_id", ("ab" * 6,), {"max_token_id": 256}, ((256,) * 6,)),
    ("two_rows", ("ab", "ab"), {}, ((256,), (256,))),
    ("across_rows", ("a", "b", "a", "b"), {}, ((97,), (98,), (97,), (98,))),
    ("two_bytes", ("éé",), {}, ((256, 256),)),
    ("half_characters", ("世",), {}, ((228, 184, 150),)),
)
_GOLDEN_ROWS = [(case, k, pos, i) for case, _, _, ids in _GOLDENS for k, row in enumerate(ids) for pos, i in enumerate(row)]


@query("golden_tokens", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {k}, {p}, {i})" for c, k, p, i in _GOLDEN_ROWS) + ") AS t(test, k, pos, token_id)")
def golden_tokens(spark, d):
    """Ids beyond the single bytes, from training to parsing."""
    out = None
    for case, rows, options, _ in _GOLDENS:
        df = spark.createDataFrame(list(enumerate(rows)), "k int, v string")
        ids = Encoder(Config(**options)).encode(df, "v", ["k"]).rows.select(F.lit(case).alias("test"), "k", F.posexplode("tokens").alias("pos", "token_id"))
        out = ids if out is None else out.unionAll(ids)
    return out


@query("golden_sizes", "SELECT * FROM (VALUES ('pair', 1294), ('pair_12', 1293), ('no_new_ids', 1292)) AS t(test, space_used)")
def golden_sizes(spark, d):
    out = None
    for case, rows, options, _ in _GOLDENS[:3]:
        df = spark.createDataFrame(list(enumerate(rows)), "k int, v string")
        size = Encoder(Config(**options)).encode(df, "v", ["k"]).space_used().select(F.lit(case).alias("test"), F.col("space_used").cast("int").alias("space_used"))
        out = size if out is None else out.unionAll(size)
    return out


@query("stratified_golden", "SELECT * FROM (VALUES (0, 'INFO service=a status=200 dur=10'), (1, 'WARN service=b timeout=100 host=10.0.0.1 ')) AS t(seq, line)")
def stratified_golden(spark, d):
    """Two kinds of lines, a budget that takes one of each, in shuffled order (permutation of 6: 4, 2, 1, 3, 0, 5)."""
    lines = ["WARN service=b timeout=200 host=10.0.0.2 ", "INFO service=a status=202 dur=30", "INFO service=a status=201 dur=20", "WARN service=b timeout=100 host=10.0.0.1 ", "INFO service=a status=200 dur=10", "WARN service=b timeout=300 host=10.0.0.3 "]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, line string")
    rows, _ = sampling.training_sample(df, "line", ["k"], Config(stratified=True, sample_bytes=73, max_clusters=8), "exact")
    return spark.createDataFrame([(i, r.decode()) for i, r in enumerate(rows)], "seq int, line string")


@query("wire_choice", "SELECT * FROM (VALUES (16, 5), (12, 15)) AS t(bits, encoding)")
def wire_choice(spark, d):
    """The encoding that 30,000 equal request lines get at either width: a deflated codebook, not the raw ids."""
    lines = spark.range(30_000).select(F.col("id").alias("k"), F.lit("GET /api/v1/users/42 HTTP/1.1").alias("v"))
    out = None
    for bits in (16, 12):
        blob = Encoder(Config(token_bits=bits)).encode(lines, "v", ["k"]).to_blobs("k")
        # The first section's frame: 8 bytes of head, 7 of lengths, the name, then the parameter.
        name = F.conv(F.hex(F.substring("blob", 9, 1)), 16, 10).cast("int")
        param = F.conv(F.hex(F.substr("blob", 16 + name, F.lit(1))), 16, 10).cast("int")
        one = blob.select(F.lit(bits).alias("bits"), param.alias("encoding"))
        out = one if out is None else out.unionAll(one)
    return out


@query("archive_violations_broken", "SELECT * FROM (VALUES ('unknown_id', 1), ('id_too_wide', 1), ('dictionary_gap', 1), ('empty_token', 1), ('identity_token', 1)) AS t(\"check\", n)")
def archive_violations_broken(spark, d):
    """One damaged archive for each rule, and what that rule finds in it."""
    plain = codec.dictionary(spark, [bytes([i]) for i in range(256)] + [b"ab"])
    rows = lambda *ids: spark.createDataFrame([(1, list(ids))], "k int, tokens array<int>")
    token = lambda i, v: plain.withColumn("token", F.when(F.col("token_id") == i, v).otherwise(F.col("token"))).withColumn("token_len", F.octet_length("token"))
    broken = (
        ("unknown_id", rows(97, 257), plain, 16), ("id_too_wide", rows(97, 4096), codec.dictionary(spark, [bytes([i % 256]) for i in range(4097)]), 12),
        ("dictionary_gap", rows(97), plain.where("token_id <> 98"), 16), ("empty_token", rows(97), token(256, F.lit(b"")), 16), ("identity_token", rows(97), token(97, F.lit(b"b")), 16),
    )
    out = None
    for name, ids, dictionary, bits in broken:
        found = analytics.violations(ids, dictionary, bits).where(F.col("check") == name).select("check", F.col("n").cast("int").alias("n"))
        out = found if out is None else out.unionAll(found)
    return out


@query("nulls_and_empties", "SELECT * FROM (VALUES (1, 'a'), (2, ''), (3, NULL), (4, 'ab' || chr(9) || 'é')) AS t(k, v)")
def nulls_and_empties(spark, d):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "ab\té")], "k int, v string")
    return train(df, "v", ["k"]).encode(df, "v").decode()


@query("compression_ratio")
def compression_ratio(spark, d):
    """Original and archive bytes of several columns (no SQL: sizes depend on the trained dictionary)."""
    out = None
    for name, value, key in (("customer", "c_name", "c_custkey"), ("events", "props", "event_id"), ("pages", "url", "page_id")):
        a = trained(spark, d, name, value, key)
        size = table(spark, d, name).agg(F.sum(F.octet_length(value)).alias("original"))
        row = size.select(F.lit(f"{name}.{value}").alias("column"), "original").join(a.space_used())
        out = row if out is None else out.union(row)
    return out
