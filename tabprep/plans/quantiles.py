"""Exact quantiles of many columns by refined histograms, and capping of outliers at them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..operators.families import is_numeric
from ..sources.parquet import without_nan

#: Parts into which a range of values is cut in a pass.
CUTS = 1 << 14


def scale(x: Column) -> Column:
    """A number's sign and power of two, as one whole number that never falls where the number grows."""
    size = F.abs(x)
    power = F.when(size == float("inf"), F.lit(3000)).otherwise(F.floor(F.log2(size)).cast("int") + 1500)
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("int") * power)


def exact_quantiles(df: DataFrame, columns: Iterable[str], shares: Iterable[float], cuts: int = CUTS) -> dict[str, list[float | None]]:
    """For each numeric column the least values that the given shares of its values don't exceed; None of a column without.

    A pass counts values in parts of the range where a quantile lies, all columns
    and shares at once, and keeps the part with the quantile's rank, with its least
    and largest value, until these are one.  The first pass cuts by powers of two
    and the next ones evenly, so the 52 bits below a power are spent after four
    more.  A pass shuffles ``cuts`` counts a task and quantile at most, and the
    driver gets one row for each quantile.  Missing cells and NaN don't count;
    whole numbers beyond 53 bits are taken as the nearest double.
    """
    columns, shares = list(columns), list(shares)
    cells = without_nan(df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    found: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    if not columns or not shares:
        return found
    n = cells.agg(*[F.count(c) for c in cells.columns]).first()
    # what is sought: column, share, rank among the values of its range, and the range, at first everything
    open_ = [(i, k, max(1, _ceil(q, n[i])), None, None) for i in range(len(columns)) if n[i] for k, q in enumerate(shares)]
    while open_:
        each = []
        for t, (i, _, _, low, high) in enumerate(open_):
            x = F.col(f"c{i}")
            if low is None:
                here, part = x.isNotNull(), scale(x)
            else:
                # halves keep the width of a range finite
                width = high / 2 - low / 2
                here, part = x.between(low, high), F.floor((x / 2 - low / 2) / F.lit(width) * (cuts - 1)).cast("int")
            each.append(F.when(here, F.struct(F.lit(t).alias("t"), part.alias("part"), x.alias("x"))))
        rows = cells.select(F.inline(F.filter(F.array(*each), lambda e: e.isNotNull())))
        parts = rows.groupBy("t", "part").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("t").orderBy("part"))
        ranks = F.element_at(F.array(*[F.lit(r).cast("long") for _, _, r, _, _ in open_]), F.col("t") + 1)
        met = parts.withColumn("upto", upto).withColumn("rank", ranks).where("upto >= rank AND upto - n < rank").collect()
        left = []
        for r in met:
            i, k, rank, _, _ = open_[r["t"]]
            if r["low"] == r["high"]:
                found[columns[i]][k] = r["low"]
            else:
                left.append((i, k, rank - (r["upto"] - r["n"]), r["low"], r["high"]))
        open_ = left
    return found


def _ceil(share: float, n: int) -> int:
    return n - int(n - share * n)


def capped(df: DataFrame, columns: Iterable[str] | None = None, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``df`` with the named (or all) numeric columns held between their exact quantiles ``low`` and ``high``.

    Missing cells, NaN included, stay missing; a column keeps its type.
    """
    names = [f.name for f in df.schema if is_numeric(f.dataType)] if columns is None else list(columns)
    bounds, kinds = exact_quantiles(df, names, (low, high)), {f.name: f.dataType for f in df.schema}

    def within(name: str) -> Column:
        a, b = bounds[name]
        x = quoted(name)
        return x if a is None else F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(a).cast(kinds[name])), F.lit(b).cast(kinds[name]))).alias(name)

    clean = without_nan(df)
    return clean.select(*[within(c) if c in names else quoted(c) for c in df.columns])
