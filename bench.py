"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds and bytes per second."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strpack.archive import from_blobs
from strpack.model import train
from strpack.plans import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
PLAIN = ("token_histogram", "codebook_payload_size", "decoded_len", "string_boundaries", "template_key_props", "template_key_lines", "stratified_quota", "group_by_on_tokens", "equality_on_tokens", "random_access", "wire_roundtrip", "per_group_models", "stream_encode")


def main() -> None:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
    for k, v in (("spark.ui.enabled", "false"), ("spark.ui.showConsoleProgress", "false"), ("spark.sql.session.timeZone", "UTC")):
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, run):
        began = time.perf_counter()
        out = run()
        seconds[name] = round(time.perf_counter() - began, 3)
        return out

    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").repartition(int(CPUS)).cache()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    sink(spark.read.parquet(f"{SF_DIR}/region.parquet").mapInArrow(lambda b: b, "r_regionkey int, r_name string"))  # Python workers up
    model = timed("fit_documents", lambda: train(docs, "text", ["doc_id"]))
    archive = model.encode(docs, "text")
    timed("encode_documents", lambda: sink(archive.rows))
    at = tempfile.mkdtemp()
    archive.rows.withColumn("part", F.col("doc_id") % int(CPUS)).write.parquet(f"{at}/rows")
    rows = spark.read.parquet(f"{at}/rows")
    stored = type(archive)(rows, archive.dictionary, archive.bits, "text")
    timed("decode_documents", lambda: sink(stored.decode()))
    timed("archive_write_documents", lambda: stored.to_blobs("doc_id", ["part"]).write.parquet(f"{at}/blobs"))
    timed("archive_read_documents", lambda: sink(from_blobs(spark.read.parquet(f"{at}/blobs").select("keys", "blob"), keys="keys")))
    for name in PLAIN:
        timed(name, lambda: sink(catalog.QUERIES[name](spark, SF_DIR)))  # noqa: B023
    rate = {k: round(size / seconds[k]) for k in ("encode_documents", "decode_documents", "archive_write_documents", "archive_read_documents")}
    print(json.dumps({"metric": "total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "bytes_per_second": rate, "document_bytes": size}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
