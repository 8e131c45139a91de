"""Contiguous shards of nearly equal size, from global prefix sums of byte sizes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick

#: Rows that one prefix sum runs over, and the most ranges that there are.
RANGE_ROWS, MOST_RANGES = 50_000, 10_000


def shard_documents(docs: DataFrame, shards: int = 16, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (doc_id, size, text_crc32, law, shard, slot, grown_shard) for each document row, law `bytes`.

    Documents stand in the order of doc_id (nulls first), then text_crc32 and size. Their
    sizes (UTF-8 bytes of the text, none for null, plus 1) are summed along
    it: ranges of the order first get their totals, a prefix sum over the
    totals gives each range's offset, and a running sum in each range does the
    rest. The middle of each document falls into one of `shards` equal
    parts of the whole sum, which is its shard; slot counts rows
    within it. A shard is off its target by at most the two documents at its
    ends. Only narrow rows are shuffled; the text is read once.

    Null and empty texts have size 1 and CRC 0. Repeated rows and ids are separate rows,
    dealt over ranges like others. More shards than rows leave some empty; an empty table gives none.
    grown_shard is null: with other shard counts, cuts move.
    """
    scratch = Scratch(docs.sparkSession)
    rows = pick(docs, doc_id=id_column, text=text_column)
    rows = rows.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"),
    )
    rows = scratch.keep(rows)  # also fixes `row`, which tells repeated rows apart
    order = ["doc_id", "text_crc32", "size", "row"]
    ranges = max(1, min(MOST_RANGES, math.ceil(rows.count() / RANGE_ROWS)))
    ranged = rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = scratch.keep(ranged.select("*", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("bytes_in"), F.count("size").over(before).alias("rows_in")))

    totals = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("size").alias("rows"))  # at most MOST_RANGES rows
    sofar = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "range", F.coalesce(F.sum("bytes").over(sofar), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(sofar), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    placed = placed.join(F.broadcast(offsets), "range").select(
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("rows_in")).alias("place"),
        F.expr(f"int(cast(2 * (bytes_before + bytes_in) + size as decimal(20, 0)) * {shards} div (2 * total))").alias("shard"),
    )
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
