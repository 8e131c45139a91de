"""A keyed table: unique keys, upsert, erase, lookup; each change makes a new snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import numbered


def upsert(base: DataFrame, changes: DataFrame, key: str = "k", value: str = "v", seq: str = "seq") -> DataFrame:
    """The base (key, value) with the last value, by seq, of each changed key."""
    return apply_log(base, changes.withColumn("_op", F.lit("insert")), key, value, seq, "_op")


def erase(base: DataFrame, keys: DataFrame, key: str = "k") -> DataFrame:
    """The base without these keys; keys that it lacks do nothing."""
    return base.join(keys.select(key).distinct(), key, "left_anti")


def lookup(base: DataFrame, keys: DataFrame, key: str = "k") -> DataFrame:
    """The asked keys with their values, null where the base has none."""
    return keys.select(key).join(base, key, "left")


def get(base: DataFrame, key_value, key: str = "k") -> DataFrame:
    """The row of one key, or none; the filter reaches the scan."""
    return base.filter(F.col(key) == F.lit(key_value))


def lower_bound(base: DataFrame, key_value, key: str = "k") -> DataFrame:
    """The first row with a key of at least this, and whether it is this key; no row beyond the last key."""
    return base.filter(F.col(key) >= F.lit(key_value)).orderBy(key).limit(1).withColumn("found", F.col(key) == F.lit(key_value))


def items(base: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """All keys and values in key order, with their places from 1 as pos."""
    return numbered(base.select(key, value), [(key, False)])


def last_changes(log: DataFrame, key: str = "k", value: str = "v", seq: str = "seq", op: str = "op") -> DataFrame:
    """(key, value, erased) after the last operation of each key, by seq; of several with the last seq, by operation (insert after erase) and value.

    The log is combined map-side to one row a key, so that a key that changes often is no load.
    """
    own = F.struct(F.col(op).alias("op"), F.col(value).alias("v"))
    last = log.groupBy(key).agg(F.max_by(own, F.struct(F.col(seq), F.col(op), F.col(value))).alias("_last"))
    return last.select(key, F.col("_last.v").alias(value), (F.col("_last.op") == "erase").alias("erased"))


def apply_log(base: DataFrame, log: DataFrame, key: str = "k", value: str = "v", seq: str = "seq", op: str = "op") -> DataFrame:
    """The base after a log of inserts and erases, see `last_changes`."""
    last = last_changes(log, key, value, seq, op).select(key, F.struct(value, "erased").alias("_last"))
    met = base.select(key, F.col(value).alias("_old")).join(last, key, "full")
    stays: Column = ~F.coalesce(F.col("_last.erased"), F.lit(False))
    return met.filter(stays).select(key, F.when(F.col("_last").isNull(), F.col("_old")).otherwise(F.col(f"_last.{value}")).alias(value))


class KeyedTable:
    """Snapshots of a keyed table in a folder; a small file names the current one's parts.

    A snapshot is a table of all rows in key order, so that a point lookup reads few row groups, and the changes since, a small
    table for each `apply`. After `changes` of them the next `apply` writes all rows anew and deletes what neither this snapshot
    nor the one before needs. One writer at a time. Readers keep the snapshot that they opened, until the second rewriting after it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "k", value: str = "v", changes: int = 8):
        self.spark, self.path, self.key, self.value, self.changes = spark, path.rstrip("/"), key, value, changes
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.files.globStatus(self.hadoop.Path(f"{self.path}/{pattern}")) or [])

    def _parts(self, pointer: str) -> list[str]:
        """The table of all rows and those of changes, in order, that a pointer names."""
        stream = self.files.open(self.hadoop.Path(f"{self.path}/{pointer}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def _current(self) -> list[str]:
        pointers = self._names("current-*")
        return self._parts(pointers[-1]) if pointers else []

    def _point(self, parts: list[str]) -> None:
        """Make the parts the current snapshot; the pointer before stays, older ones go."""
        pointers = self._names("current-*")
        number = int(pointers[-1].split("-")[1]) + 1 if pointers else 1
        stream = self.files.create(self.hadoop.Path(f"{self.path}/current-{number:012d}"), False)
        stream.write(bytearray("\n".join(parts).encode()))
        stream.close()
        for old in pointers[:-1]:
            self.files.delete(self.hadoop.Path(f"{self.path}/{old}"), False)

    def _add(self, table: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex}"
        table.repartitionByRange(F.col(self.key)).sortWithinPartitions(self.key).write.parquet(f"{self.path}/{name}")
        return name

    def _log(self, parts: list[str]) -> DataFrame | None:
        log = None
        for seq, name in enumerate(parts):
            table = self.spark.read.parquet(f"{self.path}/{name}").withColumns({"_seq": F.lit(seq), "_op": F.when(F.col("erased"), "erase").otherwise("insert")})
            log = table if log is None else log.union(table)
        return log

    def read(self) -> DataFrame | None:
        """The current snapshot; None before the first."""
        parts = self._current()
        if not parts:
            return None
        base, log = self.spark.read.parquet(f"{self.path}/{parts[0]}"), self._log(parts[1:])
        return base if log is None else apply_log(base, log, self.key, self.value, "_seq", "_op")

    def write(self, table: DataFrame) -> None:
        """Make a table the current snapshot: its files first, then the pointer; then what is no longer needed goes."""
        self._point([self._add(table.select(self.key, self.value))])
        needed = {name for pointer in self._names("current-*") for name in self._parts(pointer)}
        for name in self._names("data-*"):
            if name not in needed:
                self.files.delete(self.hadoop.Path(f"{self.path}/{name}"), True)

    def apply(self, log: DataFrame, seq: str = "seq", op: str = "op") -> None:
        """Apply a log of (key, value, seq, op) with op `insert` or `erase`: its last changes are added, or all rows written anew."""
        parts = self._current()
        if not parts:
            return self.write(apply_log(log.select(self.key, self.value).limit(0), log, self.key, self.value, seq, op))
        if len(parts) > self.changes:
            return self.write(apply_log(self.read(), log, self.key, self.value, seq, op))
        self._point([*parts, self._add(last_changes(log, self.key, self.value, seq, op))])
