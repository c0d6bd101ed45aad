"""The thin queries of the driver contract, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, licences, media, nearness, secrets, substrings, suffixes, urlfilter

#: Which vocabulary file op2 and the pipeline encode with; the file belongs to an installed package.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearness.groups(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s), n AS (SELECT doc_id, len(sh) AS n FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m ON a = doc_id
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


#: (kind, expression, test of a match): what a plain search with each expression finds. The two base kinds with a fixed
#: alphabet have their least length in the expression, which for them is the same.
_SEARCHES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 6"),
    ("access", "AKIA[A-Z0-9]{16,}", "true"),
    ("hex", "[0-9a-f]{24,}", "true"),
    ("forge", "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
    ("chat", "xox[abprs]-[A-Za-z0-9][A-Za-z0-9-]*", "length(m) >= 15"),
    ("cloud", "AIza[A-Za-z0-9_-]+", "length(m) >= 39"),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "length(m) >= 60"),
)


def _op4_sql() -> str:
    """Matches and the pieces between them give every match's place."""
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    parts = []
    for k, (kind, pattern, test) in enumerate(_SEARCHES):
        p = "'" + pattern.replace("'", "''") + "'"
        group = f"regexp_extract_all(t, {p}, 1)" if k == 0 else f"regexp_extract_all(t, {p})"
        parts.append(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, m, g, a, a + length(m) AS b FROM (SELECT doc_id, ms[i] AS m, gs[i] AS g, {size('ps[1:i]')} + {size('ms[1:i - 1]')} AS a FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS ms, {group} AS gs, string_split_regex(t, {p}) AS ps FROM d))) WHERE {test}")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) FILTER (k < 3), '') AS base, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


def remainder():
    """crc32 of doc_id as text, mod 5: 0 is held out."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder() != 0))
    found = langid.predict(docs.withColumn("held_out", remainder() == 0), model, "doc_id", "held_out")
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


#: Every window of every document that shares any shingle with an item of the window's size, by definition.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
dg AS (SELECT doc_id, unnest(range(0, len(ws) - 4)) AS p, array_to_string(ws[p + 1:p + 5], ' ') AS g FROM d WHERE len(ws) >= 5),
ig AS (SELECT item_id, len(ws) AS size, unnest(range(0, len(ws) - 4)) AS q, array_to_string(ws[q + 1:q + 5], ' ') AS g FROM i WHERE len(ws) >= 5),
c AS (SELECT doc_id, size, unnest(range(0, greatest(1, len(ws) - size + 1))) AS start FROM (SELECT DISTINCT doc_id, size FROM dg JOIN ig USING (g)) JOIN d USING (doc_id)),
w AS (SELECT doc_id, size, start, unnest(list_distinct(list_transform(range(1, len(ws[start + 1:start + size]) - 3), lambda k: array_to_string(ws[start + k:start + k + 4], ' ')))) AS g FROM c JOIN d USING (doc_id)),
s AS (SELECT DISTINCT item_id, size, g FROM ig),
wt AS (SELECT doc_id, size, start, sum(length(g)) AS t FROM w GROUP BY ALL),
st AS (SELECT item_id, sum(length(g)) AS t FROM s GROUP BY ALL),
b AS (SELECT doc_id, size, start, item_id, sum(length(g)) AS com FROM w JOIN s USING (size, g) GROUP BY ALL),
f AS (SELECT doc_id, item_id, start, com / (wt.t + st.t - com) AS similarity FROM b JOIN wt USING (doc_id, size, start) JOIN st USING (item_id) WHERE 10 * com >= 8 * (wt.t + st.t - com))
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start_word, round(similarity, 6) AS similarity FROM f
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, array_to_string(ws[i:i + 12], ' ') AS g FROM d WHERE len(ws) >= 13),
m AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
f AS (SELECT doc_id, list(i) AS starts FROM w JOIN m USING (g) WHERE first < doc_id GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, unnest(x) AS i FROM (SELECT doc_id, flatten(list_transform(starts, lambda s: range(s, s + 13))) AS x FROM f)),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT doc_id, len(ws) AS n, coalesce(len(gone), 0) AS r, list_filter(ws, lambda x, j: NOT list_contains(coalesce(gone, []), j)) AS kept FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


#: By definition: every 200-byte string (400 hex digits), its count, and the runs of bytes that repeated ones cover.
OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 199)) AS i, md5(substr(h, 2 * i + 1, 400)) AS k FROM d WHERE len(h) >= 400),
m AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
f AS (SELECT doc_id, i FROM w SEMI JOIN m USING (k)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM f),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY ALL),
b AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
t AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last FROM b JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""


def blocklist(hosts: DataFrame) -> DataFrame:
    """A stand-in for a purchased list of hosts: those whose MD5 begins with 0 to 3, about a quarter."""
    return hosts.select("host").distinct().where(F.substring(F.md5("host"), 1, 1).isin(*"0123")).select(F.col("host").alias("key"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, _ = urlfilter.host_path(F.col("url"))
    return urlfilter.judge(pages, blocklist(pages.select(host.alias("host"))))


_U, _L = urlfilter.UPPER, urlfilter.LOWER
OP10_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_U}', '{_L}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN substr(md5(host), 1, 1) IN ('0', '1', '2', '3') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_bpe": op2_bpe,
        "op3_licences": op3_licences,
        "op4_secrets": op4_secrets,
        "op5_language": op5_language,
        "op6_media": op6_media,
        "op7_decontaminate": op7_decontaminate,
        "op8_substrings": op8_substrings,
        "op9_suffixes": op9_suffixes,
        "op10_urls": op10_urls,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op4_secrets": _op4_sql(), "op7_decontaminate": OP7_SQL, "op8_substrings": OP8_SQL, "op9_suffixes": OP9_SQL, "op10_urls": OP10_SQL}
