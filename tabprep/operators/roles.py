"""Roles of columns: numeric, ordinal (text of few values) and non-ordinal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .families import is_numeric, is_text
from .shrink import apply_plan, shrink_plan


@dataclass(frozen=True)
class RoleReport:
    """Names by role, in the table's order, and the table with its numbers narrowed; other columns have no role."""

    numeric: list[str]
    ordinal: list[str]
    non_ordinal: list[str]
    table: DataFrame

    def rows(self) -> DataFrame:
        """Rows (position, column, role)."""
        roles = {c: r for r in ("numeric", "ordinal", "non_ordinal") for c in getattr(self, r)}
        listed = [(i, c, roles[c]) for i, c in enumerate(self.table.columns) if c in roles]
        return self.table.sparkSession.createDataFrame(listed, "position int, column string, role string")


def column_roles(df: DataFrame, max_categories: int = 10) -> RoleReport:
    """Splits text columns at ``max_categories`` values and narrows numbers, from one aggregate of the numbers and at most
    ``max_categories`` values a task and text column."""
    from ..plans.profile import profile
    from ..plans.values import few_values

    known = profile(df, [f.name for f in df.schema if is_numeric(f.dataType)])
    few = few_values(df, [f.name for f in df.schema if is_text(f.dataType)], max_categories)
    return RoleReport(
        list(known.columns),
        [c for c, n in few.items() if n is not None],
        [c for c, n in few.items() if n is None],
        apply_plan(df, shrink_plan(known)),
    )
