"""Work columns beside a user's own, whatever these are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column's name as ``F.col`` and ``select`` take it, with dots and backticks in it or not."""
    return "`" + name.replace("`", "``") + "`"


def own_columns(docs: DataFrame) -> list[str]:
    """All columns of ``docs``, to select them from a table that has work columns besides."""
    return [quoted(c) for c in docs.columns]


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that ``docs`` does not have, in whatever case of letters."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def row_struct(docs: DataFrame) -> Column:
    """A row as one value, under names that can't clash; :func:`row_fields` takes it apart again."""
    return F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)])


def row_fields(docs: DataFrame, row: str) -> list[Column]:
    return [F.col(row)[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)]
