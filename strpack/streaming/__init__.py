"""Structured Streaming: encoding and decoding with a frozen model are stateless maps, so streams scale like batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..model import Model
from ..operators import codec


def encode_stream(stream: DataFrame, value: str, model: Model) -> DataFrame:
    """A streaming DataFrame with its value column encoded; training stays a batch step."""
    return model.transform(stream, value)


def decode_stream(stream: DataFrame, model: Model, column: str = codec.TOKENS, out: str = "value") -> DataFrame:
    return codec.decode(stream, model._need(), column, out)


def write_encoded(stream: DataFrame, value: str, model: Model, path: str, checkpoint: str, partition_by: Sequence[str] = (), once: bool = True) -> StreamingQuery:
    """Encode into a Parquet table with the file sink's exactly-once protocol. once: process what is there, then stop."""
    out = encode_stream(stream, value, model).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        out = out.partitionBy(*partition_by)
    return (out.trigger(availableNow=True) if once else out).start()
