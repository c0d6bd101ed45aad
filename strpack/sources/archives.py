"""``spark.read.format("strpack")`` and ``df.write.format("strpack")``: directories of serialized archive files.

A file is one archive; reading gives (file STRING, row BIGINT, value BINARY), one input partition for each file. The
options ``rows`` and ``files`` (positions and file names, by commas) make it a point lookup: other files are not opened and
other rows not decoded. They are options since filters that Spark pushes into a Python source stay with the DataFrame and
would act on its later uses too. Writing
takes one column ``value`` (STRING or BINARY, not null); a partition becomes files of at most ``file_bytes`` bytes of
values (64 MiB unless told otherwise), which bounds a task's memory, each with a dictionary of its own, trained on its
values within the sample budget. Files carry a unique name and get it once they are whole; a failed task's or an aborted
job's files are removed.

Paths are those of pyarrow's file systems: local ones, file://, hdfs://, s3:// (s3a:// and s3n:// mean the same), gs://.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SUFFIX = ".spa"
FILE_BYTES = 64 << 20


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    scheme, colon, rest = path.partition("://")
    if colon and scheme in ("s3a", "s3n"):
        path = f"s3://{rest}"
    elif path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The archive files at a path: itself, or those in the folder."""
    from pyarrow import fs

    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    found = system.get_file_info(fs.FileSelector(at))
    return sorted(f.path for f in found if f.path.endswith(SUFFIX))


@dataclass
class FilePartition(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: list[int] | None, files: set[str] | None):
        self.path, self.rows, self.files = path, rows, files

    def partitions(self) -> list[InputPartition]:
        names = [n for n in listed(self.path) if self.files is None or posixpath.basename(n) in self.files]
        return [FilePartition(n) for n in names] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        from ..archive import count_rows, load_rows

        if partition.path:
            with opened(self.path)[0].open_input_stream(partition.path) as f:
                blob = f.read()
            wanted = None if self.rows is None else [r for r in self.rows if 0 <= r < count_rows(blob)]
            if wanted is None or wanted:
                for i, v in zip(range(1 << 31) if wanted is None else wanted, load_rows(blob, wanted)):
                    yield posixpath.basename(partition.path), i, v


class _Writer(DataSourceWriter):
    def __init__(self, path: str, config, at: int, overwrite: bool, file_bytes: int):
        self.path, self.config, self.at, self.file_bytes = path, config, at, file_bytes
        system, place = opened(path)
        self.old = listed(path) if overwrite and system.get_file_info(place).type.name == "Directory" else []

    def _store(self, values: list[bytes]) -> str:
        from ..archive import dump
        from ..matching import Matcher
        from ..training import train_rows

        tokens = train_rows(values, self.config)
        m = Matcher(self.config.max_token_length, tokens)
        system, place = opened(self.path)
        system.create_dir(place, recursive=True)
        name = posixpath.join(place, f"part-{uuid.uuid4().hex}{SUFFIX}")
        with system.open_output_stream(name + ".tmp") as f:
            f.write(dump([m.parse(v) for v in values], tokens, self.config.bits))
        system.move(name + ".tmp", name)
        return name

    def write(self, rows: Iterator) -> WriterCommitMessage:
        values, size, n, names = [], 0, 0, []
        for r in rows:
            v = r[self.at]
            if v is None:
                raise ValueError("a null value cannot be serialized")
            values.append(v.encode() if isinstance(v, str) else bytes(v))
            size, n = size + len(values[-1]), n + 1
            if size >= self.file_bytes:
                names.append(self._store(values))
                values, size = [], 0
        if values:
            names.append(self._store(values))
        return Written(names, n)

    def _remove(self, names: Iterable[str]) -> None:
        from pyarrow import fs

        system, _ = opened(self.path)
        for p in names:
            if system.get_file_info(p).type != fs.FileType.NotFound:
                system.delete_file(p)

    def commit(self, messages) -> None:
        self._remove(self.old)

    def abort(self, messages) -> None:
        self._remove(p for m in messages if m for p in m.paths)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strpack"

    def schema(self) -> str:
        return "file string, row bigint, value binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        rows, files = self.options.get("rows"), self.options.get("files")
        return _Reader(self.options["path"], None if rows is None else sorted({int(r) for r in rows.split(",") if r.strip()}), None if files is None else set(files.split(",")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        from ..config import Config

        names = ("threshold", "max_token_id", "max_token_length", "token_bits", "sample_bytes", "max_clusters")
        options = {k: int(self.options[k]) for k in names if k in self.options}
        if "stratified" in self.options:
            options["stratified"] = self.options["stratified"].lower() == "true"
        return _Writer(self.options["path"], Config(**options), schema.fieldNames().index("value"), overwrite, int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The same through Spark's own file listing (any Hadoop file system): path STRING, row BIGINT, value STRING."""
    from ..archive import from_blobs

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*" + SUFFIX).load(path).select("path", "content")
    return from_blobs(files, "content")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value STRING: text files, one row per line, the line end dropped."""
    return spark.read.text(path)
