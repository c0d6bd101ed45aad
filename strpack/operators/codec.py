"""Encode and decode as row-local Arrow maps; the dictionary travels as one broadcast of bounded size (65,536 tokens)."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TOP_ID, CorruptArchiveError, ShortBufferError
from ..matching import Matcher

TOKENS = "tokens"


@lru_cache(8)
def _matcher(tokens: tuple[bytes, ...], max_token_length: int) -> Matcher:
    return Matcher(max_token_length, tokens)


#: Bytes of values that are Python objects at one time; a single row may have more.
PIECE = 1 << 20


def pieces(weights: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows that weigh at most ``most`` (PIECE) together, or are one row."""
    ends, at = np.cumsum(weights, dtype=np.int64), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (most or PIECE), "right")))
        yield at, end - at
        at = end


def lengths(values: pa.Array) -> np.ndarray:
    """Bytes of each value, or ids of each list; 0 for null."""
    size = pc.binary_length(values) if pa.types.is_binary(values.type) else pc.list_value_length(values)
    return pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _mapped(df: DataFrame, column: str, out: str, sql_kind: str, function: Callable[[pa.Array], pa.Array], weigh: Callable[[pa.Array], np.ndarray] = lengths) -> DataFrame:
    """df with ``column`` replaced by ``out`` = function(array of rows); other columns pass through. A batch is worked
    off in ``pieces``, so that a task's memory does not depend on how long 10,000 rows are."""
    names = df.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, n in pieces(weigh(whole.column(at)) + 8):
                b = whole.slice(start, n)
                yield pa.RecordBatch.from_arrays([function(c) if i == at else c for i, c in enumerate(b.columns)], names=[out if i == at else n for i, n in enumerate(names)])

    fields = [f"`{out if n == column else n}` {sql_kind if n == column else k}" for n, k in df.dtypes]
    return df.mapInArrow(run, ", ".join(fields))


def listed(rows: Iterable[Sequence[int] | None]) -> pa.Array:
    """list<int32> of rows of ids; only one row is a Python list at a time."""
    flat, ends, missing = array("i"), array("i", [0]), []
    for i, row in enumerate(rows):
        if row is None:
            missing.append(i)
        else:
            flat.extend(row)
        ends.append(len(flat))
    mask = None
    if missing:
        mask = np.zeros(len(ends) - 1, bool)
        mask[missing] = True
    values = pa.array(np.frombuffer(flat, np.int32)) if flat else pa.array([], pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), values, mask=None if mask is None else pa.array(mask))


def encode(df: DataFrame, value: str, tokens: Sequence[bytes], max_token_length: int = 0, out: str = TOKENS) -> DataFrame:
    """value (STRING or BINARY) -> ARRAY<INT>. Works on streaming DataFrames as well."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(tokens))

    def parsed(values: pa.Array) -> pa.Array:
        parse = _matcher(shared.value, max_token_length).parse
        return listed(None if v is None else parse(v) for v in values.to_pylist())

    return _mapped(df.withColumn(value, F.col(value).cast("binary")), value, out, "array<int>", parsed)


@lru_cache(4)
def _table(tokens: tuple[bytes, ...]) -> pa.Array:
    return pa.array(tokens, pa.large_binary())


@lru_cache(4)
def _sizes(tokens: tuple[bytes, ...]) -> np.ndarray:
    return np.array([len(t) for t in tokens] or [0], np.int64)


def decoded(ids: pa.ListArray, tokens: tuple[bytes, ...], capacity: int | None = None) -> pa.Array:
    """The bytes behind each list of ids: one gather of tokens and one join for the whole batch; a null list stays null."""
    ids = ids.cast(pa.large_list(pa.int32()))
    flat, ends = ids.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]).astype(np.int64)
    wrong = pc.fill_null(pc.or_(pc.less(flat, 0), pc.greater_equal(flat, len(tokens))), True)
    if pc.any(wrong, min_count=0).as_py():
        at = pc.index(wrong, True).as_py()
        place = at - int(ends[np.searchsorted(ends, at, "right") - 1])
        raise CorruptArchiveError(f"token {place} has id {flat[at].as_py()}, the dictionary ends at {len(tokens) - 1}")
    out = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), _table(tokens).take(flat)), pa.scalar(b"", pa.large_binary()))
    if capacity is not None and len(out) and (need := pc.max(pc.binary_length(out)).as_py()) > capacity:
        raise ShortBufferError(f"need {need} bytes, have {capacity}")
    return pc.if_else(ids.is_valid(), out, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def decoded_sizes(ids: pa.ListArray, tokens: tuple[bytes, ...]) -> np.ndarray:
    """Bytes of ids and text of each list; ids without a token count for nothing, ``decoded`` reports them."""
    n = lengths(ids)
    flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
    known = (flat >= 0) & (flat < len(tokens))
    total = np.concatenate([[0], np.cumsum(np.where(known, _sizes(tokens)[np.where(known, flat, 0)], 0))])
    ends = np.cumsum(n)
    return 4 * n + total[ends] - total[ends - n]


def decode(df: DataFrame, tokens: Sequence[bytes], column: str = TOKENS, out: str = "value", as_string: bool = True, capacity: int | None = None) -> DataFrame:
    """ARRAY<INT> -> STRING (or BINARY). An id outside the dictionary is an error, as is a row of more than ``capacity``
    bytes."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(tokens))
    found = _mapped(df, column, out, "binary", lambda ids: decoded(ids, shared.value, capacity), lambda ids: decoded_sizes(ids, shared.value))
    return found.withColumn(out, F.col(out).cast("string")) if as_string else found


def dictionary(spark, tokens: Sequence[bytes]) -> DataFrame:
    """token_id, token, token_len."""
    table = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(tokens)], "token_id int, token binary")
    return table.withColumn("token_len", F.octet_length("token"))


def _by_id(dict_df: DataFrame, value: Column, kind: str) -> Column:
    """A constant array of ``value`` over the dictionary, whose places are the ids: at most 65,536 numbers or hex strings."""
    rows = dict_df.select("token_id", value.cast("string").alias("v")).orderBy("token_id").limit(TOP_ID + 2).collect()
    if [r.token_id for r in rows] != list(range(len(rows))) or len(rows) > TOP_ID + 1:
        raise ValueError("the dictionary has a gap, or too many tokens")
    return F.split(F.lit(",".join(r.v for r in rows)), ",").cast(f"array<{kind}>")


def _known(value: Column, token_id: Column, kind: str) -> Column:
    """value, or an error where the id has none."""
    message = F.concat(F.lit("no token has id "), F.coalesce(token_id.cast("string"), F.lit("null")))
    return F.coalesce(value, F.raise_error(message).cast(kind))


def decode_join(df: DataFrame, key: Sequence[str], dict_df: DataFrame, column: str = TOKENS, out: str = "value") -> DataFrame:
    """The same in built-in operators only: every id is looked up in the dictionary, a constant array in the
    plan. Row-local, so rows that share a key stay rows of their own; null stays null and an unknown id
    is an error here too."""
    hexes = _by_id(dict_df, F.hex("token"), "string")
    joined = F.array_join(F.transform(column, lambda i: _known(F.get(hexes, i), i, "string")), "")
    return df.select(*key, F.unhex(joined).alias(out))


def decoded_len_join(df: DataFrame, key: Sequence[str], dict_df: DataFrame, column: str = TOKENS) -> DataFrame:
    """key, decoded_len of every row: the sum of its tokens' lengths, looked up in the same way. The texts themselves are
    never built and nothing is exchanged."""
    sizes = _by_id(dict_df, F.col("token_len"), "int")
    total = F.aggregate(column, F.lit(0).cast("long"), lambda n, i: n + _known(F.get(sizes, i), i, "int"))
    return df.select(*key, total.alias("decoded_len"))
