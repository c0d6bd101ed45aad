"""A corpus pipeline of five training-data operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame, which is written as Parquet and read back as the next one's docs. All but the last stage return the
columns of documents. The driver's check writes the tables itself; ``run`` does so in the cluster's shared folder.

Edge cases, in every stage: an empty table gives an empty table; columns beyond those of documents are left behind, whatever
their names; nulls in lang, source and n_chars stay. Null and empty texts have no language, so they go in the first stage
(given to a later one, they are kept, have nothing in common with anything, and have no tokens). Repeated rows are one document: the second stage keeps one.
Rows with one id and different texts are kept or go together there, and are judged row by row elsewhere. A null id groups
with nothing. Ties between members of a group go to the least id. Very long texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strpack.llm import bpe, catalog, decontaminate, langid, nearness, secrets
from strpack.llm.common import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (no letter, or far from every centroid) go."""
    model = langid.fit(docs)
    found = langid.predict(docs, model, *COLUMNS[:1], *COLUMNS[2:], "text")
    return found.where("NOT rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (similarity 0.8 or more) stays: the least id."""
    found = nearness.groups(docs, nearness.Params(numerator=80)).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.select(*COLUMNS, F.xxhash64("text").alias("__text")).join(found, F.col("doc_id") == F.col("__gone"), "left_anti")
    # Repeated rows are one document. Where the join exchanged rows by id, they are together and need no other exchange.
    return left.dropDuplicates(["doc_id", "__text"]).select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, catalog.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in place; every document stays."""
    out = secrets.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text that they decode to."""
    return bpe.coded(docs, catalog.vocabulary())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("leaks", leaks),
    ("secrets", redacted),
    ("tokens", tokens),
]
#: Language identification and redaction by automaton are not SQL; the pipeline is tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
