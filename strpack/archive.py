"""An encoded column with its dictionary: random access, bulk decoding, sizes, validation and persistence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wire
from .config import CorruptArchiveError, ShortBufferError
from .operators import analytics, codec


#: A serialized archive holds at most so many rows and (unless one row has more) ids.
BLOB_ROWS, BLOB_IDS = 1 << 17, 1 << 22


@dataclass(frozen=True)
class Archive:
    """rows: any key columns and ``tokens`` ARRAY<INT>; dictionary: the tokens by id; bits: id width, 12 or 16."""

    rows: DataFrame
    dictionary: tuple[bytes, ...]
    bits: int = 16
    out: str = "value"
    #: The same rows before they were encoded, where known: counting and sampling keys then encodes nothing.
    source: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    @property
    def keys(self) -> list[str]:
        return [c for c in self.rows.columns if c != codec.TOKENS]

    def dictionary_df(self) -> DataFrame:
        return codec.dictionary(self.spark, self.dictionary)

    def count(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("row_count"))

    def decode(self, where: Column | str | None = None, as_string: bool = True, capacity: int | None = None) -> DataFrame:
        """Decoded rows. The filter runs before decoding - and inside the scan where rows come from Parquet - so random
        access touches the wanted rows only. capacity: an error if a row needs more bytes."""
        rows = self.rows if where is None else self.rows.where(where)
        return codec.decode(rows, self.dictionary, out=self.out, as_string=as_string, capacity=capacity)

    def row(self, **key) -> bytes | None:
        """One row by its key; IndexError if there is none."""
        found = self.rows
        for k, v in key.items():
            found = found.where(F.col(k) == v)
        got = codec.decode(found.limit(1), self.dictionary, out=self.out, as_string=False).collect()
        if not got:
            raise IndexError(f"no row {key}")
        value = got[0][self.out]
        return None if value is None else bytes(value)

    def decoded_len(self) -> DataFrame:
        """Keys and decoded_len, from token lengths alone."""
        return codec.decoded_len_join(self.rows, self.keys, self.dictionary_df())

    def append_all(self, order_by: Sequence[str], group_by: Sequence[str] = (), capacity: int | None = None) -> DataFrame:
        """All rows joined in order, one blob for each group. A group is bounded by what one row may hold (2 GiB);
        capacity: an error if a blob needs more bytes."""
        hexes = F.hex(F.col(self.out))
        decoded = self.decode(as_string=False)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order_by, hexes.alias("__hex")))), lambda x: x["__hex"]), "")
        blob = F.coalesce(F.unhex(joined), F.lit(b""))
        out = decoded.groupBy(*group_by).agg(blob.alias("blob"))
        if capacity is not None:
            short = F.concat(F.lit("short buffer: need "), F.octet_length("blob").cast("string"), F.lit(f" bytes, have {capacity}"))
            out = out.withColumn("blob", F.when(F.octet_length("blob") > capacity, F.raise_error(short).cast("binary")).otherwise(F.col("blob")))
        return out

    def decompress_all(self, order_by: Sequence[str], capacity: int) -> bytes:
        """Everything as one blob on the driver; ShortBufferError before anything is decoded if it would not fit."""
        need = self.decoded_len().agg(F.coalesce(F.sum("decoded_len"), F.lit(0))).first()[0]
        if need > capacity:
            raise ShortBufferError(f"need {need} bytes, have {capacity}")
        return bytes(self.append_all(order_by).first()["blob"])

    def space_used(self) -> DataFrame:
        """Bytes of ids (packed for 12 bits), dictionary and token boundaries (4 each); row boundaries are not in it."""
        return analytics.space_used(self.rows, self.dictionary, self.bits)

    def violations(self) -> DataFrame:
        return analytics.violations(self.rows, self.dictionary_df(), self.bits)

    def to_blobs(self, key: str, group_by: Sequence[str] = (), most_rows: int = 0) -> DataFrame:
        """Serialized archives of groups: group columns, n_rows, n_bytes, raw_bytes (what the ids at two bytes each and the
        steps between rows would take), keys ARRAY, blob. A group of more than BLOB_ROWS rows or BLOB_IDS ids comes in
        several, by ranges of keys, so a task holds one archive at a time whatever the size of a group. most_rows: at
        most so many rows in each, which column part tells apart. Rows are in key order; null rows cannot be serialized."""
        dictionary, bits = self.dictionary, self.bits
        shared = self.spark.sparkContext.broadcast(dictionary)
        kinds, groups, most = dict(self.rows.dtypes), list(group_by), most_rows or BLOB_ROWS
        columns = [*groups, *([key] if key not in groups else [])]
        rows, head = _spread(self.rows.select(*columns, "tokens"), self.source, key, groups, max(most, BLOB_ROWS)), [*groups, "__part"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole, bounds = b"".join(shared.value), np.concatenate([[0], np.cumsum([len(t) for t in shared.value])]).tolist()

            def stored(held: list[pa.RecordBatch], chunk: int) -> pa.RecordBatch:
                table = pa.Table.from_batches(held).combine_chunks()
                ids, place = table["tokens"].chunk(0), table[key].chunk(0)
                sizes, flat = pc.list_value_length(ids).to_numpy().astype(np.int64), ids.flatten().to_numpy().astype(np.int64)
                blob = wire.dumps(wire.Blob(flat, [0, *np.cumsum(sizes).tolist()], whole, bounds, bits))
                raw = 2 * len(flat) + sum(len(sizes) if i == 0 else int((sizes >> 7 * i > 0).sum()) for i in range(5))
                part = [pa.array([table["__part"][0].as_py() << 32 | chunk], pa.int64())] if most_rows else []
                body = [pa.array([n], pa.int64()) for n in (len(sizes), len(blob), raw)]
                return pa.RecordBatch.from_arrays([*[table[g].chunk(0).slice(0, 1) for g in groups], *part, *body, pa.ListArray.from_arrays(pa.array([0, len(place)], pa.int32()), place), pa.array([blob], pa.binary())], names=names)

            held, now, n, n_ids, chunk = [], None, 0, 0, 0
            for b in batches:
                tokens = b.column(b.schema.get_field_index("tokens"))
                if tokens.null_count:
                    raise CorruptArchiveError("a null row cannot be serialized")
                marks = [["nan" if v != v else v for v in b.column(b.schema.get_field_index(g)).to_pylist()] for g in head]
                start = 0
                for i, (size, *mark) in enumerate(zip(pc.list_value_length(tokens).to_pylist(), *marks)):
                    if mark != now or n >= most or n_ids + size > BLOB_IDS:
                        if i > start:
                            held.append(b.slice(start, i - start))
                        if held:
                            yield stored(held, chunk)
                        held, chunk, now, n, n_ids, start = [], chunk + 1 if mark == now else 0, mark, 0, 0, i
                    n, n_ids = n + 1, n_ids + size
                if b.num_rows > start:
                    held.append(b.slice(start))
            if held:
                yield stored(held, chunk)

        schema = [f"`{g}` {kinds[g]}" for g in groups] + ["part long"] * bool(most_rows) + ["n_rows long", "n_bytes long", "raw_bytes long", f"keys array<{kinds[key]}>", "blob binary"]
        names = [*groups, *["part"] * bool(most_rows), "n_rows", "n_bytes", "raw_bytes", "keys", "blob"]
        return rows.repartition(*head).sortWithinPartitions(*head, key).mapInArrow(run, ", ".join(schema))

    def save(self, path: str) -> None:
        """Rows and dictionary as Parquet; rows keep their partitioning, so a table sorted by key prunes by key."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.dictionary_df().coalesce(1).withColumn("bits", F.lit(self.bits)).write.mode("overwrite").parquet(f"{path}/dictionary")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Archive:
        table = spark.read.parquet(f"{path}/dictionary").orderBy("token_id").collect()
        return Archive(spark.read.parquet(f"{path}/rows"), tuple(bytes(r.token) for r in table), table[0].bits)


def _spread(rows: DataFrame, source: DataFrame | None, key: str, groups: list[str], most: int) -> DataFrame:
    """rows with ``__part``: 0 in groups of at most ``most`` rows; larger groups are split into ranges of keys of about so
    many rows. Only the counts of larger groups are broadcast, and only borders between ranges reach the driver."""
    plain = rows if source is None else source
    n = plain.count()
    if n <= most:
        return rows.withColumn("__part", F.lit(0).cast("long"))
    ranges = -(-n // most)
    rows = analytics.ranged(rows, [key], out="__part", at=analytics.borders(plain, [key], ranges))
    part = F.col("__part").cast("long")
    if groups:
        large = plain.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(F.ceil(F.count("*") / most).alias("__many")).where(F.col("__many") > 1)
        same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
        rows = rows.join(F.broadcast(large), same, "left")
        part = F.floor(part * F.coalesce("__many", F.lit(0)) / (ranges + 1)).cast("long")
    return rows.select(*[c for c in rows.columns if not c.startswith("__")], part.alias("__part"))


def dump(ids: list[list[int]], dictionary: Sequence[bytes], bits: int) -> bytes:
    """One serialized archive of rows of ids."""
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.array([i for x in ids for i in x], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in dictionary])]).tolist()
    return wire.dumps(wire.Blob(flat, [0, *np.cumsum(sizes).tolist()], b"".join(dictionary), bounds, bits))


def load_rows(blob: bytes, wanted: Sequence[int] | None = None) -> list[bytes]:
    """The decoded rows of a serialized archive: all, or those at the wanted positions, others staying encoded."""
    b = wire.loads(blob)
    token = [b.dictionary[x:y] for x, y in zip(b.bounds, b.bounds[1:])]
    n = len(b.rows) - 1
    if wanted is not None and any(not 0 <= i < n for i in wanted):
        raise IndexError(f"the archive has {n} rows")
    return [b"".join([token[i] for i in b.tokens[b.rows[r] : b.rows[r + 1]].tolist()]) for r in (range(n) if wanted is None else wanted)]


def count_rows(blob: bytes) -> int:
    """Number of rows, from the boundaries alone."""
    return wire.row_count(blob)


def from_blobs(df: DataFrame, blob: str = "blob", keys: str | None = None, as_string: bool = True, wanted: Sequence | None = None) -> DataFrame:
    """Rows of serialized archives: the other columns of df, row (position, or the key from the ``keys`` list), value.
    wanted: only rows with these positions or keys; no other row is decoded, and a blob without any is not even opened
    where its keys tell."""
    others = [c for c in df.columns if c not in (blob, keys)]
    kinds = dict(df.dtypes)
    chosen = None if wanted is None else pa.array(sorted(set(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                data = b.column(b.schema.get_field_index(blob))[r]
                place = b.column(b.schema.get_field_index(keys))[r].values if keys else None
                at = None
                if chosen is not None:
                    if place is None:
                        place = pa.array(range(count_rows(data.as_py())), pa.int64())
                    at = pc.indices_nonzero(pc.is_in(place, value_set=chosen.cast(place.type))).to_pylist()
                    if not at:
                        continue
                values = load_rows(data.as_py(), at)
                if place is None:
                    place = pa.array(range(len(values)), pa.int64())
                elif at is not None:
                    place = place.take(pa.array(at))
                if len(place) != len(values):
                    raise CorruptArchiveError(f"{len(values)} rows, {len(place)} keys")
                rest = [pa.array([b.column(b.schema.get_field_index(c))[r].as_py()] * len(values), b.schema.field(c).type) for c in others]
                yield pa.record_batch([*rest, place, pa.array(values, pa.binary())], names=[*others, "row", "value"])

    kind = kinds[keys][len("array<") : -1] if keys else "bigint"
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + [f"row {kind}", "value binary"])
    out = df.mapInArrow(run, schema)
    return out.withColumn("value", F.col("value").cast("string")) if as_string else out
