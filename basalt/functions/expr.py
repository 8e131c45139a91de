"""Typed scalar expressions over bigint and double columns.

Integer +, - and * wrap around at 64 bits, integer division truncates, casts
convert (to bigint: toward zero). Operands have one type; nothing is cast unasked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import place, plain, wrapping

I64, F64 = "bigint", "double"


class Expr:
    """A node with a type; `+ - * /` build the binary ones."""

    type: str

    def __add__(self, other: Expr) -> Expr:
        return Binary("+", self, other)

    def __sub__(self, other: Expr) -> Expr:
        return Binary("-", self, other)

    def __mul__(self, other: Expr) -> Expr:
        return Binary("*", self, other)

    def __truediv__(self, other: Expr) -> Expr:
        return Binary("/", self, other)


@dataclass(frozen=True, eq=False)
class Const(Expr):
    """An int or float."""

    value: int | float

    @property
    def type(self) -> str:
        return F64 if isinstance(self.value, float) else I64


@dataclass(frozen=True, eq=False)
class Arg(Expr):
    """The column at a place or of a name, as bigint or double."""

    ref: int | str
    type: str = I64


@dataclass(frozen=True, eq=False)
class Cast(Expr):
    """A converting cast."""

    child: Expr
    type: str


@dataclass(frozen=True, eq=False)
class Binary(Expr):
    """left op right, both of one type, which is also the result's."""

    op: str
    left: Expr
    right: Expr

    def __post_init__(self):
        if self.left.type != self.right.type:
            raise TypeError(f"{self.left.type} {self.op} {self.right.type}: cast one side")

    @property
    def type(self) -> str:
        return self.left.type


def with_expressions(df: DataFrame, **exprs: Expr) -> DataFrame:
    """Add a column for each expression.

    Operations that wrap are analysed with ANSI checks off, divisions and casts with
    them on. So the tree is cut where the two meet, into nested projections that
    Catalyst merges again.
    """
    spark, names, width = df.sparkSession, df.columns, len(df.columns)
    table, made = plain(df), 0

    def wraps(e: Expr) -> bool:
        return isinstance(e, Binary) and e.op != "/" and e.type == I64

    def add(column: Column, soft: bool) -> Column:
        nonlocal table, made
        made += 1
        if soft:
            with wrapping(spark):
                table = table.withColumn(f"e{made}", column)
        else:
            table = table.withColumn(f"e{made}", column)
        return F.col(f"e{made}")

    def build(e: Expr, soft: bool) -> Column:
        """soft: the surrounding projection is analysed with checks off."""
        if isinstance(e, Const):
            return F.lit(e.value).cast(e.type)
        if isinstance(e, Arg):
            column = F.col(f"c{place(df, e.ref)}")
            return column if df.schema[place(df, e.ref)].dataType.simpleString() == e.type else add(column.cast(e.type), False)
        own = wraps(e)
        if isinstance(e, Cast):
            column = build(e.child, False).cast(e.type)
        else:
            left, right = build(e.left, own), build(e.right, own)
            if e.op == "/" and e.type == I64:
                column = F.call_function("div", left, right)
            else:
                column = {"+": left + right, "-": left - right, "*": left * right}[e.op] if e.op != "/" else left / right
        return column if own == soft else add(column, own)

    out = [build(e, False) for e in exprs.values()]
    return table.select(*(F.col(f"c{i}") for i in range(width)), *out).toDF(*names, *exprs)
