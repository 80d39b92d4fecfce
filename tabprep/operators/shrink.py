"""Narrowing of 64-bit numbers to the smallest type that holds them."""

from __future__ import annotations

from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.columns import quoted
from .families import is_wide

if TYPE_CHECKING:
    from ..plans.profile import ColumnProfile, TableProfile

#: Integer types by size, and how far a float may lie from a double.
INTEGERS = ((8, T.ByteType()), (16, T.ShortType()), (32, T.IntegerType()))
TOLERANCE = 5e-4


class Narrowing(NamedTuple):
    column: str
    before: T.DataType
    after: T.DataType


def narrowest(column: ColumnProfile) -> T.DataType:
    """The type that a column may take; columns without values take the smallest."""
    if isinstance(column.type, T.LongType):
        low, high = column.low or 0, column.high or 0
        return next((t for bits, t in INTEGERS if -(1 << bits - 1) <= low and high < 1 << bits - 1), column.type)
    if isinstance(column.type, T.DoubleType):
        return T.FloatType() if (column.float_error or 0.0) <= TOLERANCE else column.type
    return column.type


def shrink_plan(known: TableProfile) -> list[Narrowing]:
    """The type of each 64-bit column before and after, kept ones included."""
    return [Narrowing(c.name, c.type, narrowest(c)) for c in known.columns.values() if is_wide(c.type)]


def apply_plan(df: DataFrame, plan: list[Narrowing]) -> DataFrame:
    casts = {n.column: n.after for n in plan if n.after != n.before}
    return df.select(*[quoted(c).cast(casts[c]).alias(c) if c in casts else quoted(c) for c in df.columns])


def shrink(df: DataFrame) -> DataFrame:
    """All columns, the 64-bit ones narrowed where no integer is lost and no double moves by more than TOLERANCE."""
    from ..plans.profile import profile

    return apply_plan(df, shrink_plan(profile(df, [f.name for f in df.schema if is_wide(f.dataType)])))
