"""Structured Streaming into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.index import KeyedTable


def maintain(changes: DataFrame, table: KeyedTable, seq: str = "seq", op: str = "op") -> DataStreamWriter:
    """A writer that applies each micro-batch of a streaming log to the table; batches must come in seq order."""
    return changes.writeStream.foreachBatch(lambda batch, _: table.apply(batch, seq, op))
