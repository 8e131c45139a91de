"""The engine's types, columns by name or place, and bit fields of page ids."""

from __future__ import annotations

from contextlib import contextmanager
from threading import RLock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, CharType, IntegerType, LongType, ShortType, StringType, VarcharType

INTEGERS, STRINGS = (LongType, IntegerType, ShortType, ByteType), (StringType, CharType, VarcharType)
#: The sign bit: exclusive or with it turns unsigned order into signed order.
SIGN = -(2**63)
TURNED = RLock()


def char16(column: Column | str) -> Column:
    """A string padded with spaces (or cut) to 16 characters."""
    return F.rpad(column, 16, " ")


def place(df: DataFrame, ref: int | str) -> int:
    """The place of a column given by place or by a name that only one column has."""
    if isinstance(ref, int):
        if not 0 <= ref < len(df.columns):
            raise IndexError(f"no column {ref} in {df.columns}")
        return ref
    if df.columns.count(ref) != 1:
        raise ValueError(f"{df.columns.count(ref)} columns are called {ref!r}")
    return df.columns.index(ref)


def plain(df: DataFrame) -> DataFrame:
    """The table with columns named c0, c1, ... by place."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def kind(df: DataFrame, at: int) -> str:
    """`int`, `string`, or the name of another type."""
    own = df.schema[at].dataType
    return "int" if isinstance(own, INTEGERS) else "string" if isinstance(own, STRINGS) else own.simpleString()


@contextmanager
def wrapping(spark):
    """Integer +, -, * and SUM of plans that are built inside wrap around at 64 bits; Spark fixes that as it analyses a plan.

    The session's mode is turned for as long as that takes, by one thread at a time.
    """
    with TURNED:
        before = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)


def unsigned_key(column: Column) -> Column:
    """A bigint whose signed order is the unsigned order of the column's 64 bits."""
    return column.bitwiseXOR(F.lit(SIGN))


def segment_id(page: Column) -> Column:
    """The upper 16 bits of a page id."""
    return F.shiftrightunsigned(page, 48)


def segment_page_id(page: Column) -> Column:
    """The lower 48 bits of a page id."""
    return page.bitwiseAND(F.lit(2**48 - 1))
