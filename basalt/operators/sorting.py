"""Ascending sort of files of unsigned 64-bit integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import u64

#: Most ranges that a small memory leads to.
RANGES = 10_000


def generate(spark: SparkSession, count: int, random: bool = False, seed: int = 0) -> DataFrame:
    """Keys of count, ..., 1, or of count random values of the full range."""
    if random:
        return spark.range(count).select(F.xxhash64("id", F.lit(seed)).alias("key"))
    return u64.keys(spark.range(count).select((F.lit(count) - F.col("id")).alias("v")))


def external_sort(spark: SparkSession, source: str, target: str, memory: int | None = None) -> None:
    """Write the values of a file in ascending order, duplicates kept, as part files in order.

    Spark samples ranges, shuffles by them and sorts each, spilling what memory does not
    hold. memory, in bytes, is how large a range is to be (with RANGES at most); it changes no result. No values give an empty target.
    """
    table = u64.read_keys(spark, source)
    if memory:
        ranges = max(1, min(RANGES, -(-table.count() * 8 // memory)))
        table = table.repartitionByRange(ranges, "key").sortWithinPartitions("key")
    else:
        table = table.orderBy("key")
    u64.write_keys(table, target)
