"""The profile's figures for every subset of grouping columns, from one pre-aggregate."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..operators.families import is_numeric, is_text
from ..sources.parquet import without_nan
from .values import most_frequent

#: Parts into which the rows of a group are dealt before they are summed.
PARTS = 32


def grouped_profile(df: DataFrame, by: Iterable[str], columns: Iterable[str] | None = None, sets: Iterable[tuple[str, ...]] | None = None) -> DataFrame:
    """Rows (by..., grouping, column, n_rows, non_null, n_distinct, mean, mode, low, high) for every group of every set.

    ``sets`` are subsets of ``by``, all of them if not given; a column that isn't in
    a row's set is NULL there and so is, apart from it, a missing cell.
    ``grouping`` tells these apart: its bit is 1 for each column of ``by``, the last
    one lowest, that isn't in the set.  Numeric columns have mean, low and high (as
    doubles), text columns the number of values and the most frequent one, the
    smallest of equals.  NaN is missing.  Tables without rows give no rows.

    The table is read once for counts and sums by all of ``by``, and once for counts
    of text values; every set is summed up from these.  Rows are counted by
    (group, value) before they are shuffled, and values of a group lie apart, so a
    hot group has no task of its own.
    """
    by = list(by)
    df = without_nan(df)
    kinds = {f.name: f.dataType for f in df.schema}
    wanted = [c for c in (df.columns if columns is None else columns) if c not in by and (is_numeric(kinds[c]) or is_text(kinds[c]))]
    sets = [s for n in range(len(by) + 1) for s in combinations(by, n)] if sets is None else list(sets)
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*[quoted(c).alias(k) for c, k in zip(by, keys, strict=True)], *[quoted(c).alias(f"c{i}") for i, c in enumerate(wanted)])

    # one row a finest group and column
    sums = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(wanted):
        x = F.col(f"c{i}")
        number = x.cast("double") if is_numeric(kinds[c]) else F.lit(None).cast("double")
        parts = [F.lit(i).alias("at"), F.count(x).alias("non_null"), F.sum(number).alias("total"), F.min(number).alias("low"), F.max(number).alias("high")]
        sums.append(F.struct(*parts).alias(f"s{i}"))
    finest = rows.groupBy(*keys).agg(*sums)
    finest = finest.select(*keys, "n_rows", F.inline(F.array(*[F.col(f"s{i}") for i in range(len(wanted))])))
    text = [i for i, c in enumerate(wanted) if is_text(kinds[c])]
    cells = [F.when(F.col(f"c{i}").isNotNull(), F.struct(F.lit(i).alias("at"), F.col(f"c{i}").alias("value"))) for i in text]
    none = F.array().cast("array<struct<at:int,value:string>>")
    given = rows.select(*keys, F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull()) if cells else none))
    counted = given.groupBy(*keys, "at", "value").agg(F.count(F.lit(1)).alias("n"))

    # the sets of each row: its keys, those outside the set as NULL
    def member(s: tuple[str, ...]) -> Column:
        bits = sum(1 << (len(by) - 1 - i) for i, c in enumerate(by) if c not in s)
        own = [(F.col(k) if c in s else F.lit(None).cast(kinds[c])).alias(f"g{k}") for c, k in zip(by, keys, strict=True)]
        return F.struct(*own, F.lit(bits).alias("grouping"))

    in_sets, groups = F.array(*[member(s) for s in sets]), [f"g{k}" for k in keys] + ["grouping"]
    figures = finest.select("*", F.inline(in_sets)).groupBy(*groups, "at").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("non_null").alias("non_null"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    values = counted.select("at", "value", "n", F.inline(in_sets)).groupBy(*groups, "at", "value").agg(F.sum("n").alias("n"))
    # values of a large group are compared in parts first
    part = F.pmod(F.xxhash64("value"), F.lit(PARTS))
    best = values.groupBy(*groups, "at", part.alias("part")).agg(F.count(F.lit(1)).alias("n_distinct"), most_frequent().alias("value"), F.max("n").alias("n"))
    best = best.groupBy(*groups, "at").agg(F.sum("n_distinct").alias("n_distinct"), most_frequent().alias("mode"))
    same = [figures[g].eqNullSafe(best[g]) for g in (*groups, "at")]
    met = figures.join(best, same, "left")
    is_text_column = F.element_at(F.array(*[F.lit(is_text(kinds[c])) for c in wanted]), figures["at"] + 1)
    return met.select(
        *[figures[f"g{k}"].alias(c) for c, k in zip(by, keys, strict=True)],
        figures["grouping"],
        F.element_at(F.array(*map(F.lit, wanted)), figures["at"] + 1).alias("column"),
        "n_rows",
        "non_null",
        F.when(is_text_column, F.coalesce("n_distinct", F.lit(0))).cast("long").alias("n_distinct"),
        (F.col("total") / F.nullif("non_null", F.lit(0))).alias("mean"),
        "mode",
        "low",
        "high",
    )
