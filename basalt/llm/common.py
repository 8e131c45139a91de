"""What the operators of this subpackage share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructField, StructType

from ..operators.scratch import Scratch

__all__ = ["LOWER", "UPPER", "WORD", "Scratch", "bounded_batches", "extended", "fits", "free_name", "pick", "sealed", "small"]

#: ASCII white space, which alone separates words.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most bytes of a broadcast side, and of an Arrow batch.
BROADCAST, BATCH = 16 << 20, 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """For programs, not for operators: Arrow batches of 2 MB in this session, unless it has a limit of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names; found by position, so other columns may have any names."""
    names = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"c{names.index(name)}").alias(new) for new, name in columns.items()))


def sealed(df: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """The table with columns c0, c1, ..., those names in order, and the new name of each old one."""
    new = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*new), new, dict(zip(reversed(df.columns), reversed(new), strict=True))


def free_name(name: str, columns: list[str]) -> str:
    """The name, or with _2, _3, ... behind the first that no column has in any case of letters."""
    taken, new, n = {c.lower() for c in columns}, name, 1
    while new.lower() in taken:
        n += 1
        new = f"{name}_{n}"
    return new


def fits(df: DataFrame, limit: int = BROADCAST) -> bool:
    """Whether the table's values have at most so many bytes. One aggregation measures it, so it is to be a written table or a cheap plan of one."""

    def width(name: str, kind: DataType):
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(name), F.lit(0)) + 16
        if isinstance(kind, ArrayType):
            return 16 + 8 * F.greatest(F.size(name), F.lit(0))
        return F.lit(8)

    size = reduce(lambda a, b: a + b, (width(f.name, f.dataType).cast("long") for f in df.schema.fields))
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def small(df: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """Marked for broadcast if it `fits`; beyond that Spark shuffles, and splits hot keys."""
    return F.broadcast(df) if fits(df, limit) else df


def extended(df: DataFrame, name: str, kind: str) -> StructType:
    """The table's schema with one more column."""
    return StructType([*df.schema.fields, StructField(name, DataType.fromDDL(kind))])
