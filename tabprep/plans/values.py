"""Few values and most frequent values of text columns, decided without shuffling their cells."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted

#: Values that a task counts for a column; values that may be the most frequent one and are looked up by a broadcast.
HELD, SURVIVORS = 128, 1000


def given(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[quoted(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])


def few_values(df: DataFrame, columns: Iterable[str], most: int) -> dict[str, int | None]:
    """How many values each text column has, missing ones aside, or None if they are more than ``most``.  Exact.

    A task holds ``most`` + 1 values of a column and sends them, or only that there
    are more; from then on it passes the column over, and it stops once that holds
    for all columns.  So ``most`` values a task and column are shuffled at most.
    """
    columns = list(columns)
    if not columns:
        return {}

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set] = {i: set() for i in range(len(columns))}
        for batch in batches:
            for i, values in list(held.items()):
                values.update(pc.unique(batch.column(i).drop_null()).to_pylist())
                if len(values) > most:
                    del held[i]
            if not held:
                break
        over = [i for i in range(len(columns)) if i not in held]
        at, value = over + [i for i, v in held.items() for _ in v], [None] * len(over) + [x for v in held.values() for x in v]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(value, pa.string())], ["at", "value"])

    sent = given(df, columns).mapInArrow(per_task, "at int, value string").distinct()
    found = sent.groupBy("at").agg(F.count("value").alias("n"), F.bool_or(F.col("value").isNull()).alias("over")).collect()
    n = {r["at"]: None if r["over"] or r["n"] > most else r["n"] for r in found}
    return {c: n.get(i, 0) for i, c in enumerate(columns)}


def reduced(counts: dict[str, int], most: int) -> int:
    """Takes the same number off all counts so that ``most`` stay above zero, the rest being left out; returns that number."""
    if len(counts) <= most:
        return 0
    off = sorted(counts.values(), reverse=True)[most]
    for value in [v for v, n in counts.items() if n <= off]:
        del counts[value]
    for value in counts:
        counts[value] -= off
    return off


def counters(df: DataFrame, columns: list[str], held: int = HELD) -> DataFrame:
    """Rows (at, value, n, error) by which each column's values are counted, one set of ``held`` counters at most a task.

    A value of column ``at`` occurs as often as its ``n`` say together, and more
    often by the column's ``error`` together at most, values without rows included.
    Counters merge by addition.  Rows without a value tell a task's error.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[dict[str, int]] = [{} for _ in columns]
        error = [0] * len(columns)
        for batch in batches:
            for i, own in enumerate(counts):
                for pair in pc.value_counts(batch.column(i).drop_null()).to_pylist():
                    own[pair["values"]] = own.get(pair["values"], 0) + pair["counts"]
                error[i] += reduced(own, held)
        rows = []
        for i, own in enumerate(counts):
            # values counted once beside others that were given up tell nothing
            if error[i] and any(n == 1 for n in own.values()):
                own, error[i] = {v: n - 1 for v, n in own.items() if n > 1}, error[i] + 1
            rows += [(i, v, n, 0) for v, n in own.items()] + ([(i, None, 0, error[i])] if error[i] else [])
        at, value, n, off = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(value, pa.string()), pa.array(n, pa.int64()), pa.array(off, pa.int64())], ["at", "value", "n", "error"])

    return given(df, columns).mapInArrow(per_task, "at int, value string, n long, error long")


def most_frequent(n: str = "n", value: str = "value") -> Column:
    """The value of the largest number, the smallest of equals."""
    return F.min_by(value, F.struct(-F.col(n), F.col(value)))


def modes(df: DataFrame, columns: Iterable[str], held: int = HELD, survivors: int = SURVIVORS) -> dict[str, str | None]:
    """The most frequent value of each text column, the smallest of equals; None if it has none.  Exact.

    Counters of bounded size tell for most columns which values can be it: those
    whose count and error together reach the largest count.  If nothing was given
    up, that is the answer; if they are few and every other value is rarer, they
    are counted in a second pass, met by a broadcast.  Columns where that fails,
    such as those of unique texts, have their values' hashes counted (96 bits), not
    the texts; values of the largest hash count are then compared where they lie.
    """
    columns = list(columns)
    if not columns:
        return {}
    sums = counters(df, columns, held).groupBy("at", "value").agg(F.sum("n").alias("n"), F.sum("error").alias("error")).persist()
    try:
        totals = sums.groupBy("at").agg(F.sum("error").alias("off"), F.max("n").alias("top"), most_frequent().alias("best"))
        known = {r["at"]: r for r in totals.collect()}
        found = {i: r["best"] for i, r in known.items() if not r["off"]}
        close = sums.join(F.broadcast(totals), "at").where("value IS NOT NULL AND off > 0 AND top > off AND n + off >= top")
        n_close = {r["at"]: r["count"] for r in close.groupBy("at").count().collect()}
        few = [i for i, n in n_close.items() if n <= survivors]
        again = close.where(F.col("at").isin(few)).select("at", "value").collect() if few else []
    finally:
        sums.unpersist()
    hashed = [i for i in known if i not in found and i not in few]
    cells = given(df, columns)
    if again:
        wanted = df.sparkSession.createDataFrame(again, "at int, value string")
        looked_at = exploded(cells, few, lambda c: c)
        counted = looked_at.join(F.broadcast(wanted), ["at", "value"]).groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
        found |= {r["at"]: r["best"] for r in counted.groupBy("at").agg(most_frequent().alias("best")).collect()}
    if hashed:
        found |= by_hashes(cells, hashed, survivors)
    return {c: found.get(i) for i, c in enumerate(columns)}


def exploded(cells: DataFrame, which: list[int], change: Callable[[Column], Column]) -> DataFrame:
    """Rows (at, value) of the cells of some columns that aren't missing, each changed."""
    each = F.array(*[F.struct(F.lit(i).alias("at"), change(F.col(f"c{i}")).alias("value")) for i in which])
    present = F.filter(F.array(*[F.when(F.col(f"c{i}").isNotNull(), each[k]) for k, i in enumerate(which)]), lambda x: x.isNotNull())
    return cells.select(F.inline(present))


def by_hashes(cells: DataFrame, which: list[int], survivors: int) -> dict[int, str | None]:
    """The most frequent values of columns in which many are about equally frequent."""

    def print_(c: Column) -> Column:
        return F.struct(F.xxhash64(c).alias("long"), F.hash(c).alias("short"))

    counted = exploded(cells, which, print_).groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
    # by number of occurrences, of which there are few
    spread = counted.groupBy("at", "n").agg(F.count(F.lit(1)).alias("values")).groupBy("at").agg(F.max(F.struct("n", "values")).alias("top")).collect()
    top = {r["at"]: r["top"] for r in spread}
    single = [i for i in which if i in top and top[i]["n"] == 1]
    found = {}
    if single:
        # nothing occurs twice
        least = cells.agg(*[F.min(f"c{i}").alias(f"c{i}") for i in single]).first()
        found |= {i: least[f"c{i}"] for i in single}
    rest = [i for i in which if i in top and top[i]["n"] > 1]
    if rest:
        at_top = reduce(or_, [(F.col("at") == i) & (F.col("n") == top[i]["n"]) for i in rest])
        large = counted.where(at_top).select("at", F.col("value").alias("print"))
        large = F.broadcast(large) if sum(top[i]["values"] for i in rest) <= survivors * 100 else large
        met = exploded(cells, rest, lambda c: c).withColumn("print", print_(F.col("value"))).join(large, ["at", "print"], "left_semi")
        found |= {r["at"]: r["best"] for r in met.groupBy("at").agg(F.min("value").alias("best")).collect()}
    return found
