"""Families of column types.  Truth values, times and nested types belong to none."""

from __future__ import annotations

from pyspark.sql import types as T


def is_numeric(kind: T.DataType) -> bool:
    """Numbers of any width."""
    return isinstance(kind, T.NumericType)


def is_wide(kind: T.DataType) -> bool:
    """64-bit numbers, the ones that may be narrowed."""
    return isinstance(kind, (T.LongType, T.DoubleType))


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)
