"""What the operators share: intermediate tables in the cluster's shared folder, size estimates and Arrow plumbing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or the context's checkpoint folder. Where
    neither is set, a local master has its own; on a cluster that is an error."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at and not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        at = _LOCAL.get(context.applicationId) or _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="strpack-"))
    return at.rstrip("/")


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._strpack_at = at
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a DataFrame made by cut(), once nothing reads it any more."""
    spark, at = df.sparkSession, df._strpack_at
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the input (file sizes for file scans); 1 TiB where the plan has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(size, 1 << 50)


def bins(df: DataFrame, each: int, least: int = 16) -> int:
    """Number of groups for an exchange, in proportion to the input, so that one group stays at about ``each`` bytes."""
    return max(least, -(-input_bytes(df) // each))


def release() -> None:
    """Give freed memory back to the system: an idle worker stays beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def by_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow with a function from batch to batch. done: called at the end of each task, to let go of what the worker
    process remembers; it may serve other stages next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows and (out := function(batch)) is not None:
                    yield out
        finally:
            if done:
                done()
            release()

    return df.mapInArrow(run, schema)


def text_of(df: DataFrame, *keys: str, text: str = "text"):
    """The key columns and the text as bytes; other columns, whatever their names, are left behind at the scan."""
    return df.select(*[F.col(k) for k in keys], F.col(text).cast("binary").alias("text"))
