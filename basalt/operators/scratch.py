"""Written tables that cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, in the one that the session names in spark.checkpoint.dir.

    Only where driver and executors are one process may the setting be absent; a temporary folder serves
    then. A cluster without it is an error: a local folder would be another one on each machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/basalt-{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def sweep(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application now, not when it ends; results that are not yet computed from them are lost.

    A driver that was killed leaves its folder, which bears the application's id, to be deleted by hand.
    """
    path, files = _file_system(spark, shared_folder(spark))
    files.delete(path, True)


class Scratch:
    """Written tables in the application's shared folder.

    They cut lineage and survive lost executors. Operators drop those that their result does not read; the others go with `sweep`, or when
    the application ends.
    """

    def __init__(self, spark: SparkSession):
        folder = shared_folder(spark)
        self.spark, self.root, self.kept = spark, f"{folder}/{uuid.uuid4().hex}", 0
        path, self.files = _file_system(spark, folder)
        self.files.deleteOnExit(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the table and return it as read back."""
        path = self.folder()
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch = path
        return table

    def folder(self) -> str:
        """A path of its own for a table that something else writes."""
        self.kept += 1
        return os.path.join(self.root, str(self.kept))

    def clear(self) -> None:
        """Delete all tables kept so far."""
        self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.root), True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for table in tables:
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch), True)
