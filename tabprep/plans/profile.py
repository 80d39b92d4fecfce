"""All statistics of a table's columns from one action."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted
from ..operators.families import is_numeric, is_text
from .values import modes


@dataclass(frozen=True)
class ColumnProfile:
    """What is known of a column; fields that don't fit its type are None.

    ``float_error`` is the largest difference of a double from its nearest float,
    infinite where a finite value has no finite float.
    """

    name: str
    type: T.DataType
    non_null: int
    distinct: int | None = None
    mean: float | None = None
    mode: str | None = None
    low: int | None = None
    high: int | None = None
    float_error: float | None = None


@dataclass(frozen=True)
class TableProfile:
    rows: int
    columns: dict[str, ColumnProfile]

    def null_fraction(self, name: str) -> float:
        """The part of missing cells; of an empty table's columns 0."""
        return 1 - self.columns[name].non_null / self.rows if self.rows else 0.0


ROW = "column string, rows long, non_null long, distinct long, mean double, mode string, low long, high long, float_error double"


def profile(df: DataFrame, only: Iterable[str] | None = None, counts_only: bool = False, distinct: bool = True) -> TableProfile:
    """Profiles columns in one action.

    With ``counts_only`` rows and non-null cells alone are counted, by partial
    aggregates of one narrow pass; the other fields stay None.  Without
    ``distinct`` text columns' values aren't counted, which shuffles them; their
    modes come from :func:`~tabprep.plans.values.modes`, in actions of its own.

    One aggregate over the table covers counts, means, ranges and rounding errors.
    Text columns are unpivoted to (column, value) and counted by value, from which
    distinct counts and modes (the smallest of the most frequent values) follow;
    that spills, unlike a map of values for each column, and costs one shuffle
    however many columns there are.
    """
    wanted = list(df.columns if only is None else only)
    kinds = {f.name: f.dataType for f in df.schema}
    text = [c for c in wanted if is_text(kinds[c])] if distinct and not counts_only else []
    modal = {} if distinct or counts_only else modes(df, [c for c in wanted if is_text(kinds[c])])
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, name in enumerate(wanted):
        c, kind = quoted(name), kinds[name]
        aggregates.append(F.count(c).alias(f"n{i}"))
        parts = {"mean": "CAST(NULL AS DOUBLE)", "low": "CAST(NULL AS BIGINT)", "high": "CAST(NULL AS BIGINT)", "float_error": "CAST(NULL AS DOUBLE)"}
        if is_numeric(kind) and not counts_only:
            aggregates.append(F.avg(c).cast("double").alias(f"mean{i}"))
            parts["mean"] = f"mean{i}"
        if isinstance(kind, T.LongType) and not counts_only:
            aggregates += [F.min(c).alias(f"low{i}"), F.max(c).alias(f"high{i}")]
            parts |= {"low": f"low{i}", "high": f"high{i}"}
        if isinstance(kind, T.DoubleType) and not counts_only:
            narrow = c.cast("float").cast("double")
            aggregates.append(F.max(F.when(narrow == c, F.lit(0.0)).otherwise(F.abs(narrow - c))).alias(f"error{i}"))
            parts["float_error"] = f"error{i}"
        rows.append(f"{i}, rows, n{i}, CAST(NULL AS BIGINT), {parts['mean']}, CAST(NULL AS STRING), {parts['low']}, {parts['high']}, {parts['float_error']}")
    names = "at, rows, non_null, distinct, mean, mode, low, high, float_error"
    total = "-1, rows, rows, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE)"
    found = df.agg(*aggregates).selectExpr(f"stack({len(rows) + 1}, {', '.join([total, *rows])}) AS ({names})")
    if text:
        cells = F.array(*[F.struct(F.lit(wanted.index(c)).alias("at"), quoted(c).cast("string").alias("value")) for c in text])
        counted = df.select(F.explode(cells).alias("cell")).where("cell.value IS NOT NULL").groupBy("cell.at", "cell.value").agg(F.count(F.lit(1)).alias("n"))
        best = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
        values = counted.groupBy("at").agg(F.count(F.lit(1)).alias("distinct"), best.alias("mode"))
        none = {c: F.lit(None).cast("double" if c in ("mean", "float_error") else "long") for c in ("rows", "non_null", "mean", "low", "high", "float_error")}
        found = found.unionByName(values.select("at", "distinct", "mode", *[v.alias(k) for k, v in none.items()]))
    known: dict[int, dict] = {}
    for row in found.collect():
        known.setdefault(row["at"], {}).update({k: v for k, v in row.asDict().items() if v is not None})
    columns = {}
    for i, name in enumerate(wanted):
        r = known[i]
        values = r.get("distinct", 0) if name in text else None
        columns[name] = ColumnProfile(name, kinds[name], r["non_null"], values, r.get("mean"), r.get("mode", modal.get(name)), r.get("low"), r.get("high"), r.get("float_error"))
    return TableProfile(known[-1]["rows"], columns)
