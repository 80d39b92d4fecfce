"""A loaded table with its selectors and reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import selectors
from ..operators.families import is_numeric, is_text
from ..operators.roles import RoleReport, column_roles
from ..operators.shrink import Narrowing, apply_plan, shrink_plan
from ..sources.delimited import read_delimited
from .profile import TableProfile, profile

#: Neutral names of types for reports.
TYPE_NAMES = {
    T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64",
    T.StringType: "text", T.BooleanType: "boolean", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp", T.DateType: "date",
}


def type_name(kind: T.DataType) -> str:
    return TYPE_NAMES.get(type(kind), kind.simpleString())


class Catalogue:
    """Holds a table; selectors return new tables, ``shrink`` replaces the held one."""

    def __init__(self, table: DataFrame):
        self.table = table
        self._profile: TableProfile | None = None

    @classmethod
    def read(cls, spark: SparkSession, location: str, sample_size: int = 10_000) -> Catalogue:
        """The first rows of a tab-separated file; lines with too many fields are left out."""
        return cls(read_delimited(spark, location, limit=sample_size, bad_lines="skip"))

    def profile(self) -> TableProfile:
        """The statistics of all numeric and text columns, computed once for the held table."""
        if self._profile is None:
            self._profile = profile(self.table, [f.name for f in self.table.schema if is_numeric(f.dataType) or is_text(f.dataType)])
        return self._profile

    def wide_numeric(self) -> DataFrame:
        return selectors.wide_numeric(self.table)

    def pick(self, names: Iterable[str]) -> DataFrame | None:
        return selectors.pick(self.table, names)

    def text_except(self, names: Iterable[str]) -> DataFrame:
        return selectors.text_except(self.table, names)

    def text_except_dates(self, names: Iterable[str]) -> DataFrame:
        return selectors.text_except_dates(self.table, names)

    def low_cardinality(self, threshold: int) -> DataFrame:
        return selectors.low_cardinality(self.table, threshold)

    def n_unique(self, name: str) -> int | None:
        return selectors.n_unique(self.table, name)

    def roles(self, max_categories: int = 10) -> RoleReport:
        return column_roles(self.table, max_categories)

    def shrink_plan(self) -> list[Narrowing]:
        return shrink_plan(self.profile())

    def shrink(self) -> DataFrame:
        """Narrows the held table's numbers and returns it; from then on they are no longer among the 64-bit ones."""
        self.table = apply_plan(self.table, self.shrink_plan())
        self._profile = None
        return self.table

    def types(self) -> DataFrame:
        """Rows (position, column, type) with neutral type names."""
        listed = [(i, f.name, type_name(f.dataType)) for i, f in enumerate(self.table.schema)]
        return self.table.sparkSession.createDataFrame(listed, "position int, column string, type string")

    def info(self) -> DataFrame:
        """Rows (position, column, type, non_null, n_rows) of all columns."""
        known = profile(self.table, counts_only=True)
        listed = [(i, f.name, type_name(f.dataType), known.columns[f.name].non_null, known.rows) for i, f in enumerate(self.table.schema)]
        return self.table.sparkSession.createDataFrame(listed, "position int, column string, type string, non_null long, n_rows long")

    def head(self, n: int = 5) -> DataFrame:
        return self.table.limit(n)

    def show(self, n: int = 5) -> None:
        """Prints the first rows, cells in full."""
        self.table.show(n, truncate=False)

    def describe_unique(self, name: str) -> str:
        """A line on a column's number of values, or that it is missing."""
        n = self.n_unique(name)
        return f"no column {name!r}" if n is None else f"{name!r} has {n} values"
