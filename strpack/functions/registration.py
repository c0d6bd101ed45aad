"""SQL access: encode, decode, decoded_len and token_stream under a model, and template_key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import CorruptArchiveError
from ..matching import Matcher
from ..model import Model
from .templates import template_key_sql


def register(spark: SparkSession, model: Model, prefix: str = "strpack_") -> list[str]:
    """Register <prefix>encode(value) ARRAY<INT>, <prefix>decode(ids) STRING, <prefix>decoded_len(ids) BIGINT,
    <prefix>template_key(line) STRING and the table function <prefix>token_stream(value): (pos, token_id, token).
    Scalars are Arrow-batched; for large jobs prefer the DataFrame operators, which carry nothing per call."""
    if not model.trained:
        model._need()
    shared, longest = spark.sparkContext.broadcast(model.tokens), model.config.max_token_length

    def raw(v) -> bytes:
        return v.encode() if isinstance(v, str) else bytes(v)

    def pieces(ids) -> list[bytes]:
        try:
            return [shared.value[i] for i in ids]
        except IndexError as e:
            raise CorruptArchiveError("token id outside the dictionary") from e

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(longest, shared.value)
        for s in batches:
            yield s.map(lambda v: None if v is None else m.parse(raw(v)))

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda ids: None if ids is None else b"".join(pieces(ids)).decode("utf-8", "replace"))

    @F.pandas_udf("long")
    def decoded_len(s: pd.Series) -> pd.Series:
        return pd.Series([None if ids is None else sum(map(len, pieces(ids))) for ids in s], dtype="Int64")

    class TokenStream:
        def __init__(self):
            self.matcher = None

        def eval(self, value):
            if value is None:
                return
            if self.matcher is None:
                self.matcher = Matcher(longest, shared.value)
            for pos, i in enumerate(self.matcher.parse(raw(value))):
                yield pos, i, shared.value[i]

    names = []
    for name, f in (("encode", encode), ("decode", decode), ("decoded_len", decoded_len)):
        spark.udf.register(prefix + name, f)
        names.append(prefix + name)
    # No Python here: the body is an expression that the optimizer sees.
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}template_key(line STRING) RETURNS STRING RETURN {template_key_sql('line')}")
    names.append(prefix + "template_key")
    spark.udtf.register(prefix + "token_stream", F.udtf(TokenStream, returnType="pos int, token_id int, token binary"))
    return [*names, prefix + "token_stream"]
