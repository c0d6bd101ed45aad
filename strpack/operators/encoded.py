"""Relational work on encoded values. Under one dictionary equal texts have equal ids and vice versa, so equality,
grouping, DISTINCT and equi-joins need no decoding; order and prefixes do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..archive import Archive
from ..model import Model
from . import codec


def where_equals(archive: Archive, model: Model, *values: str | bytes) -> Archive:
    """Rows equal to one of the literals; these are encoded once, on the driver, and the filter runs on ids."""
    wanted = [F.array(*[F.lit(i) for i in model.encode_literal(v)]).cast("array<int>") for v in values]
    test: Column = F.lit(False)
    for w in wanted:
        test = test | (F.col(codec.TOKENS) == w)
    return Archive(archive.rows.where(test), archive.dictionary, archive.bits, archive.out)


def group_by_value(archive: Archive, *aggregates: Column) -> DataFrame:
    """Aggregates per distinct value: grouped by ids, and only the groups' values are decoded."""
    grouped = archive.rows.groupBy(codec.TOKENS).agg(*(aggregates or (F.count("*").alias("n"),)))
    return codec.decode(grouped, archive.dictionary, out=archive.out)


def distinct_values(archive: Archive) -> DataFrame:
    return codec.decode(archive.rows.select(codec.TOKENS).distinct(), archive.dictionary, out=archive.out)


def join(left: Archive, right: Archive, how: str = "inner", right_columns: Sequence[str] = ()) -> DataFrame:
    """Equi-join of two columns encoded with the same dictionary; the joined ids stay in ``tokens``."""
    if left.dictionary != right.dictionary:
        raise ValueError("the two archives have different dictionaries; decode or encode again first")
    other = right.rows.select(codec.TOKENS, *right_columns) if right_columns else right.rows
    return left.rows.join(other, codec.TOKENS, how)
