"""Projections chosen by schema or by cardinality.  Names are compared exactly, whatever Spark's case rule."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted
from .families import is_numeric, is_text, is_wide


def chosen(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in names])


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, of any width."""
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def wide_numeric(df: DataFrame) -> DataFrame:
    """The 64-bit numeric columns; narrowed ones are no longer among them."""
    return chosen(df, [f.name for f in df.schema if is_wide(f.dataType)])


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Without the named columns; absent names don't matter."""
    gone = set(names)
    return chosen(df, [c for c in df.columns if c not in gone])


def pick(df: DataFrame, names: Iterable[str]) -> DataFrame | None:
    """The named columns in that order, or None if one is missing; no names give a table without columns."""
    wanted = list(names)
    return chosen(df, wanted) if set(wanted) <= set(df.columns) else None


def text_except(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The text columns but the named ones."""
    gone = set(names)
    return chosen(df, [c for c in text_columns(df) if c not in gone])


def text_except_dates(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """As :func:`text_except`, and without names that hold ``date`` in any case, even inside a word."""
    gone = set(names)
    return chosen(df, [c for c in text_columns(df) if c not in gone and "date" not in c.lower()])


def n_unique(df: DataFrame, name: str) -> int | None:
    """How many values a column of any type has, missing ones aside; None if there is no such column."""
    if name not in df.columns:
        return None
    return df.agg(F.count_distinct(quoted(name))).first()[0]


def low_cardinality(df: DataFrame, threshold: int) -> DataFrame:
    """The text columns with at most ``threshold`` values, missing ones aside; no cells are shuffled to find them."""
    from ..plans.values import few_values

    return chosen(df, [c for c, n in few_values(df, text_columns(df), threshold).items() if n is not None])
