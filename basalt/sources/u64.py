"""Headerless files of little-endian unsigned 64-bit integers."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.types import SIGN
from ..operators.relational import in_order

#: Values of a read partition and of an Arrow batch, and bytes that are copied at once.
PART, BATCH, COPY = 1 << 22, 1 << 17, 8 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it: mounted folders, s3://, gs:// and hdfs://. ValueError for those that only Spark reads."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError) as error:
        raise ValueError(f"{path}: {error}") from error


def parts(files: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """A file itself, or the part files of a folder in the order of their names."""
    info = files.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    return sorted((x for x in files.get_file_info(fs.FileSelector(path)) if x.base_name.startswith("part-")), key=lambda x: x.base_name)


@dataclass
class Slice(InputPartition):
    path: str
    first: int
    count: int


@dataclass
class Part(WriterCommitMessage):
    made: str
    final: str


class U64Source(DataSource):
    """`u64le`: one column `key` (bigint), the value with its top bit turned, so that signed order is the values' order.

    A path is a file, or a folder of part files whose order is their names'.
    """

    @classmethod
    def name(cls) -> str:
        return "u64le"

    def schema(self) -> str:
        return "key bigint"

    def reader(self, schema) -> DataSourceReader:
        return U64Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return U64Writer(self.options["path"], overwrite)


class U64Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        found = parts(*store(self.path))
        return [Slice(x.path, i, min(PART, x.size // 8 - i)) for x in found for i in range(0, x.size // 8, PART)] or [Slice("", 0, 0)]

    def read(self, part: Slice):
        if not part.count:
            return
        with store(self.path)[0].open_input_file(part.path) as file:
            for first in range(part.first, part.first + part.count, BATCH):
                values = np.frombuffer(file.read_at(8 * min(BATCH, part.first + part.count - first), 8 * first), "<u8")
                yield pa.RecordBatch.from_arrays([pa.array((values ^ np.uint64(2**63)).view(np.int64))], ["key"])


class U64Writer(DataSourceArrowWriter):
    """Each task writes a file of a name of its own; commit gives those of the tasks that count their final names."""

    def __init__(self, path: str, overwrite: bool):
        self.uri = path
        files, self.path = store(path)
        info = files.get_file_info(self.path)
        if info.type == fs.FileType.File and overwrite:
            files.delete_file(self.path)
        elif info.type != fs.FileType.NotFound and not overwrite and (info.type == fs.FileType.File or files.get_file_info(fs.FileSelector(self.path))):
            raise FileExistsError(path)
        files.create_dir(self.path, recursive=True)

    def write(self, batches) -> Part:
        from pyspark import TaskContext

        made = f"{self.path}/.{uuid.uuid4().hex}"
        with store(self.uri)[0].open_output_stream(made) as file:
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                file.write((keys.view(np.uint64) ^ np.uint64(2**63)).astype("<u8").tobytes())
        return Part(made, f"{self.path}/part-{TaskContext.get().partitionId():06d}.u64")

    def commit(self, messages) -> None:
        files = store(self.uri)[0]
        for old in parts(files, self.path):  # of what is overwritten
            files.delete_file(old.path)
        for m in messages:
            if m is not None:
                files.move(m.made, m.final)

    def abort(self, messages) -> None:
        files = store(self.uri)[0]
        for m in messages:
            if m is not None and files.get_file_info(m.made).type == fs.FileType.File:
                files.delete_file(m.made)


def _of_records(record: Column) -> Column:
    """The key of 8 little-endian bytes."""
    digits = F.hex(record)
    return F.conv(F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2))), 16, -10).cast("bigint").bitwiseXOR(F.lit(SIGN))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The column `key` of a file in any store that Spark reads, by its reader of fixed records and column functions."""
    jvm = spark._jvm
    records = spark._jsparkSession.createDataset(spark._jsc.binaryRecords(path, 8).rdd(), jvm.org.apache.spark.sql.Encoders.BINARY())
    return DataFrame(records.toDF(), spark).select(_of_records(F.col("value")).alias("key"))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """The column `key` of a file; what `store` does not open goes through `read_records`."""
    try:
        store(path)
    except ValueError:
        return read_records(spark, path)
    spark.dataSource.register(U64Source)
    return spark.read.format("u64le").option("path", path).load()


def values(keys: DataFrame) -> DataFrame:
    """The column v, decimal(20, 0), for the column `key`; others stay behind."""
    v = (F.col("key").cast("decimal(20, 0)") + F.lit(str(2**63)).cast("decimal(20, 0)")).cast("decimal(20, 0)")
    return keys.select(v.alias("v"), *(c for c in keys.columns if c != "key"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The values of a file as v, decimal(20, 0)."""
    return values(read_keys(spark, path))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """The values of a file as v with their places in it, from 1, as pos."""
    return values(in_order(read_keys(spark, path)))


def keys(table: DataFrame, column: str = "v") -> DataFrame:
    """The column `key` of values from 0 to 2^64 - 1."""
    return table.select((F.col(column).cast("decimal(20, 0)") - F.lit(str(2**63)).cast("decimal(20, 0)")).cast("bigint").alias("key"))


def write_keys(table: DataFrame, path: str) -> None:
    """Write the column `key` as a folder of part files, partition by partition. ValueError for stores that only Spark reads."""
    store(path)
    table.sparkSession.dataSource.register(U64Source)
    table.select("key").write.format("u64le").mode("overwrite").option("path", path).save()


def join_parts(folder: str, target: str) -> None:
    """Put the part files of a folder together as one file, a piece at a time, and delete the folder."""
    files, path = store(folder)
    to, final = store(target)
    with to.open_output_stream(f"{final}.made") as out:
        for part in parts(files, path):
            with files.open_input_stream(part.path) as file:
                while piece := file.read(COPY):
                    out.write(piece)
    if to.get_file_info(final).type == fs.FileType.Directory:
        to.delete_dir(final)
    to.move(f"{final}.made", final)
    files.delete_dir(path)
