"""Projection, selection, join, aggregation, order and set operations.

Columns are given by name or place. Inputs are taken as not null; what holds for
nulls is Spark's rule: predicates and joins drop them, groups and sets hold them equal.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import char16, kind, place, plain, wrapping
from .scratch import Scratch

COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


def _unique(names: list[str]) -> list[str]:
    """The names, with _2, _3, ... behind those that are taken."""
    out: list[str] = []
    for name in names:
        new, n = name, 1
        while new in out:
            n += 1
            new = f"{name}_{n}"
        out.append(new)
    return out


def project(df: DataFrame, refs: list[int | str]) -> DataFrame:
    """The columns in this order; a column may come twice, no row goes."""
    at = [place(df, r) for r in refs]
    return plain(df).select(*(F.col(f"c{i}").alias(f"o{k}") for k, i in enumerate(at))).toDF(*_unique([df.columns[i] for i in at]))


def _filtered(df: DataFrame, condition: Column) -> DataFrame:
    return plain(df).filter(condition).toDF(*df.columns)


def select_i64(df: DataFrame, ref: int | str, op: str, value: int) -> DataFrame:
    """Rows whose integer column compares so with a constant; TypeError for other columns."""
    at = place(df, ref)
    if kind(df, at) != "int":
        raise TypeError(f"column {df.columns[at]} is no integer")
    return _filtered(df, COMPARE[op](F.col(f"c{at}"), F.lit(value).cast("bigint")))


def select_char16(df: DataFrame, ref: int | str, op: str, value: str, *, padded: bool = True) -> DataFrame:
    """Rows whose string column compares so with a constant, bytewise and with trailing blanks; padded: both to 16 characters first."""
    at = place(df, ref)
    if kind(df, at) != "string":
        raise TypeError(f"column {df.columns[at]} is no string")
    column = F.col(f"c{at}")
    if not padded:
        return _filtered(df, COMPARE[op](column, F.lit(value)))
    fixed = value.ljust(16)[:16]
    return _filtered(df, _implied(column, op, fixed) & COMPARE[op](char16(column), F.lit(fixed)))


def _implied(column: Column, op: str, fixed: str) -> Column:
    """What must hold of the stored string where the padded one compares so: a filter that a scan can use.

    A padded string that equals the constant starts with the constant's part before its blanks. One that
    is not above it is not so itself unless it starts with it (longer ones are cut). One that is not below it is not
    below the constant up to its first character before the blank, since blanks come in where the string ends.
    """
    start = fixed.rstrip(" ")
    if op == "eq":
        return column.startswith(start)
    if op in ("lt", "le"):
        return (column <= F.lit(fixed)) | column.startswith(fixed)
    if op in ("gt", "ge"):
        cut = next((i for i, c in enumerate(start) if c < " "), len(start))
        return column >= F.lit(start[:cut].rstrip(" "))
    return F.lit(True)


def select_attr(df: DataFrame, left: int | str, op: str, right: int | str) -> DataFrame:
    """Rows in which two columns compare so. Values of different types differ; they have no order: TypeError."""
    a, b = place(df, left), place(df, right)
    if kind(df, a) != kind(df, b):
        if op not in ("eq", "ne"):
            raise TypeError(f"{df.columns[a]} and {df.columns[b]} have different types and so no order")
        return _filtered(df, F.lit(op == "ne"))
    return _filtered(df, COMPARE[op](F.col(f"c{a}"), F.col(f"c{b}")))


def hash_join(left: DataFrame, right: DataFrame, left_key: int | str, right_key: int | str, *, strict_unique: bool = False, build: str | None = None) -> DataFrame:
    """Inner join where one column of each side is equal; all of the left's columns, then all of the right's.

    Left keys need to be unique for the usual key join; others give every
    pair, or with strict_unique an error. Spark chooses the join; build `left` asks for
    a hash table of the left side.
    """
    a, b = place(left, left_key), place(right, right_key)
    if kind(left, a) != kind(right, b):
        raise TypeError(f"{left.columns[a]} and {right.columns[b]} have different types")
    if strict_unique and not plain(left).groupBy(f"c{a}").count().filter("count > 1").isEmpty():
        raise ValueError(f"{left.columns[a]} is not unique")
    l, r = plain(left), right.toDF(*(f"r{i}" for i in range(len(right.columns))))
    l = l.hint("shuffle_hash") if build == "left" else l
    return l.join(r, F.col(f"c{a}") == F.col(f"r{b}")).toDF(*_unique([*left.columns, *right.columns]))


def hash_aggregate(df: DataFrame, keys: list[int | str], aggregates: list[tuple[str, int | str]] = ()) -> DataFrame:
    """Keys, then aggregates (min, max, sum, count) in the order given.

    count counts rows. sum is of integers, as bigint that wraps around. Without
    keys there is one row, but none for an empty input; without aggregates the distinct keys.
    """
    at = [place(df, k) for k in keys]
    table, out = plain(df), []
    for i, (function, ref) in enumerate(aggregates):
        column = place(df, ref)
        if function not in ("min", "max", "sum", "count"):
            raise ValueError(f"no aggregate {function!r}")
        if function == "sum" and kind(df, column) != "int":
            raise TypeError(f"sum of {df.columns[column]}, which is no integer")
        own = F.count(F.lit(1)) if function == "count" else getattr(F, function)(F.col(f"c{column}"))
        out.append((own.alias(f"a{i}"), f"{function}_{df.columns[column]}"))
    if not out:
        return table.select(*(f"c{i}" for i in at)).distinct().toDF(*_unique([df.columns[i] for i in at]))
    with wrapping(df.sparkSession):
        grouped = table.groupBy(*[F.col(f"c{i}") for i in at] or [F.lit(1).alias("one")]).agg(*(a for a, _ in out))
    return grouped.select(*(f"c{i}" for i in at), *(f"a{i}" for i in range(len(out)))).toDF(*_unique([*(df.columns[i] for i in at), *(n for _, n in out)]))


def sort(df: DataFrame, criteria: list[tuple[int | str, bool]]) -> DataFrame:
    """Rows in lexicographic order of (column, descending) criteria; ties in any order."""
    order = [F.col(f"c{place(df, ref)}").desc() if desc else F.col(f"c{place(df, ref)}").asc() for ref, desc in criteria]
    return plain(df).orderBy(*order).toDF(*df.columns)


def in_order(df: DataFrame, name: str = "pos", *, keep: list[int | str] | None = None) -> DataFrame:
    """The rows with their places, from 1, in the order of partitions and in them, as a column; of the others only those to keep, if told.

    The ids of `monotonically_increasing_id` are partition and row in it. They are written with the kept columns, and
    the partitions' counts, combined map-side, give their offsets.
    """
    at = range(len(df.columns)) if keep is None else [place(df, ref) for ref in keep]
    rows = Scratch(df.sparkSession).keep(plain(df).select(*(F.col(f"c{i}").alias(f"o{k}") for k, i in enumerate(at)), F.monotonically_increasing_id().alias("_id")))
    counts = rows.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(offsets), F.shiftright("_id", 33) == F.col("_part"))  # one row for each partition
    inside = F.col("_id").bitwiseAND(F.lit(2**33 - 1))
    return out.select(*(f"o{k}" for k in range(len(at))), (F.col("_before") + inside + 1).alias("_pos")).toDF(*_unique([*(df.columns[i] for i in at), name]))


def numbered(df: DataFrame, criteria: list[tuple[int | str, bool]], name: str = "pos", *, keep: list[int | str] | None = None) -> DataFrame:
    """`sort` with the place of each row, from 1, as a column; of the others only those to keep, if told.

    One shuffle deals the rows into ranges, each is sorted, and they are numbered as they leave the sort (`in_order`).
    """
    order = [F.col(f"c{place(df, ref)}").desc() if desc else F.col(f"c{place(df, ref)}").asc() for ref, desc in criteria]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = plain(df).repartitionByRange(ranges, *order).sortWithinPartitions(*order).toDF(*df.columns)
    return in_order(ranged, name, keep=keep)


def _aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides, checked to have as many columns of the same kinds; integers as bigint."""
    if len(left.columns) != len(right.columns):
        raise ValueError(f"{len(left.columns)} and {len(right.columns)} columns")
    for i in range(len(left.columns)):
        if kind(left, i) != kind(right, i):
            raise TypeError(f"column {i}: different types")

    def wide(df):
        return plain(df).select(*(F.col(f"c{i}").cast("bigint").alias(f"c{i}") if kind(df, i) == "int" else F.col(f"c{i}") for i in range(len(df.columns))))

    return wide(left), wide(right)


def _set(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = _aligned(left, right)
    return getattr(a, name)(b).toDF(*left.columns)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of either side once."""
    return _set("union", left, right).distinct()


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both sides."""
    return _set("union", left, right)


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of both sides once."""
    return _set("intersect", left, right)


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row as often as in the side that has it less often."""
    return _set("intersectAll", left, right)


def except_(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of the left that the right does not have, once."""
    return _set("subtract", left, right)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row as often as the left has it more often than the right."""
    return _set("exceptAll", left, right)


def lines(df: DataFrame) -> DataFrame:
    """A column `line` with the attributes of each row, parted by commas and not quoted; null as an empty field."""
    fields = [F.coalesce(F.col(f"c{i}").cast("string"), F.lit("")) for i in range(len(df.columns))]
    return plain(df).select(F.concat_ws(",", *fields).alias("line"))


def write_lines(df: DataFrame, path: str) -> None:
    """Write `lines` as text files."""
    lines(df).write.text(path)
