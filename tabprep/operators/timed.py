"""Joins by time: the last row at or before another, points in intervals, and their sums."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..sources.staging import shared_folder

#: Rows of a key (or of a cell) from which it is split, parts of a key's time, and rows that are broadcast at most.
MOST, CELLS, BROADCAST_ROWS = 1_000_000, 200, 200_000


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once and read back."""
    path = f"{shared_folder(df.sparkSession)}/timed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(kept: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows are few enough."""
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def named(df: DataFrame, on: list[str], time: str) -> tuple[list[Column], Column]:
    return [quoted(c).alias(f"k{i}") for i, c in enumerate(on)], quoted(time).alias("time")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], time: str, prefix: str = "right_", most: int = MOST, cells: int = CELLS) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of the same ``on`` at or before its ``time``.

    ``right``'s columns but ``on`` come under ``prefix``; they are NULL if there is
    no such row, and so they are for rows of ``left`` whose key or time is missing.
    Of rows of one key and time in ``right`` the largest counts, column by column.

    Both tables are merged by key and time, and a running last value carries
    ``right``'s rows on.  A key of more than ``most`` rows is cut into cells of
    about equal numbers of rows along its time; what a cell begins with is carried
    over from the cells before.  Rows of one key and one time stay together.
    """
    keys, names = [f"k{i}" for i in range(len(on))], [c for c in right.columns if c not in on]
    (own, at), (theirs, then) = named(left, on, time), named(right, on, time)
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(left.columns)])
    last = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])
    nothing = F.lit(None).cast(left.select(row.alias("x")).schema["x"].dataType)
    no_row = F.lit(None).cast(right.select(last.alias("x")).schema["x"].dataType)
    here = F.lit(True)
    for c in (*on, time):
        here &= quoted(c).isNotNull()
    a = left.where(here).select(*own, at, row.alias("row"), no_row.alias("last"))
    b = right.where(here).select(*theirs, then, nothing.alias("row"), last.alias("last"))
    both = a.unionByName(b)
    counts = written(both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*keys))
    hot = small(counts)
    is_hot = not counts.isEmpty()
    if is_hot:
        shares = [k / cells for k in range(1, cells)]
        cuts = both.join(hot, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("time", shares, 100 * cells).alias("cuts"))
        # once written, cells are fixed, whatever an approximate percentile would be another time
        cuts = small(written(cuts))
        both = both.join(cuts, keys, "left").withColumn("cell", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("time"))), F.lit(0))).drop("cuts")
    else:
        both = both.withColumn("cell", F.lit(0))
    order = [F.col("time"), F.col("row").isNotNull(), F.col("last")]
    running = Window.partitionBy(*keys, "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("found", F.last("last", ignorenulls=True).over(running)).where("row IS NOT NULL")
    if is_hot:
        ends = both.where("last IS NOT NULL").join(hot, keys, "left_semi").groupBy(*keys, "cell").agg(F.max(F.struct("time", "last"))["last"].alias("last"))
        every = both.join(hot, keys, "left_semi").select(*keys, "cell").distinct().join(ends, [*keys, "cell"], "left")
        before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.select(*keys, "cell", F.last("last", ignorenulls=True).over(before).alias("carried"))
        met = met.join(small(written(carried)), [*keys, "cell"], "left").withColumn("found", F.coalesce("found", "carried"))
    whole = met.select("row", "found").unionByName(left.where(~here).select(row.alias("row"), no_row.alias("found")))
    return whole.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"found.c{i}").alias(prefix + c) for i, c in enumerate(names)])


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], time: str, start: str, end: str, prefix: str = "in_", most: int = MOST) -> DataFrame:
    """Each row of ``points`` with each row of ``intervals`` of the same ``on`` whose ``start`` <= ``time`` < ``end``.

    The numbers ``time``, ``start`` and ``end`` are whole.  ``intervals``' columns
    but ``on`` come under ``prefix``; missing keys and bounds meet nothing.

    An interval lies in one or two cells whose width is the power of two at or
    above its length; a point looks into its cell of each width that occurs, 64 at
    most.  A cell with more than ``most`` points is split: its points are dealt,
    its intervals repeated.
    """
    keys, names = [f"k{i}" for i in range(len(on))], [c for c in intervals.columns if c not in on]
    width = F.greatest(F.lit(0), F.ceil(F.log2(F.col("stop") - F.col("start")))).cast("int")
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(points.columns)])
    other = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])
    given = intervals.select(*[quoted(c).alias(k) for c, k in zip(on, keys, strict=True)], quoted(start).cast("long").alias("start"), quoted(end).cast("long").alias("stop"), other.alias("other"))
    given = given.where("stop > start").withColumn("width", width)
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("width"))).cast("long")
    given = given.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("stop") - 1))))
    widths = sorted(r["width"] for r in given.select("width").distinct().collect())
    asked = points.where(quoted(time).isNotNull()).select(*[quoted(c).alias(k) for c, k in zip(on, keys, strict=True)], quoted(time).cast("long").alias("time"), row.alias("row"))
    asked = asked.withColumn("width", F.explode(F.array(*map(F.lit, widths)).cast("array<int>"))).withColumn("cell", cell(F.col("time")))
    at = [*keys, "width", "cell"]
    counts = written(asked.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
    if counts.isEmpty():
        met = asked.join(given, at)
    else:
        parts = counts.select(*at, F.ceil(F.col("n") / most).cast("int").alias("parts"))
        parts = F.broadcast(parts) if counts.count() <= BROADCAST_ROWS else parts
        several = F.coalesce("parts", F.lit(1))
        dealt = asked.join(parts, at, "left").withColumn("part", F.pmod(F.xxhash64("time", "row"), several).cast("int")).drop("parts")
        copies = given.join(parts, at, "left").withColumn("part", F.explode(F.sequence(F.lit(0), several - 1))).drop("parts")
        met = dealt.join(copies, [*at, "part"])
    met = met.where("start <= time AND time < stop")
    return met.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(points.columns)], *[F.col(f"other.c{i}").alias(prefix + c) for i, c in enumerate(names)])


def attached(rows: DataFrame, table: DataFrame, at: list[str], most: int) -> DataFrame:
    """``rows`` with the columns of the one row that ``table`` has for their ``at``; rows of a key with more than ``most`` are dealt, its row in ``table`` repeated."""
    counts = written(rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
    if counts.isEmpty():
        return rows.join(table, at)
    parts = small(written(counts.select(*at, F.ceil(F.col("n") / most).cast("int").alias("parts"))))
    several = F.coalesce("parts", F.lit(1))
    rest = [c for c in rows.columns if c not in at]
    dealt = rows.join(parts, at, "left").withColumn("part", F.pmod(F.xxhash64(*rest), several).cast("int")).drop("parts")
    copies = table.join(parts, at, "left").withColumn("part", F.explode(F.sequence(F.lit(0), several - 1))).drop("parts")
    return dealt.join(copies, [*at, "part"]).drop("part")


def interval_totals(points: DataFrame, intervals: DataFrame, on: list[str], time: str, start: str, end: str, sums: list[str], most: int = MOST) -> DataFrame:
    """Each row of ``intervals`` with the number and sums of the ``points`` that :func:`interval_join` would meet it with, if there are any.

    ``n`` counts the points and each of ``sums`` adds up that column of theirs,
    without a row for each pair.  Points are added up once by time and by cells
    whose widths are powers of two; an interval is made up of two cells of each
    width at most, so the work grows with the rows and the logarithm of the
    longest interval.  Nothing is subtracted, so sums of doubles lose no digits.
    Equal intervals are looked up once.
    """
    keys, totals = [f"k{i}" for i in range(len(on))], [f"s{i}" for i in range(len(sums))]
    own = [quoted(c).alias(k) for c, k in zip(on, keys, strict=True)]
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(intervals.columns)])
    given = intervals.select(*own, quoted(start).cast("long").alias("start"), quoted(end).cast("long").alias("stop"), row.alias("row")).where("stop > start")
    for k in keys:
        given = given.where(F.col(k).isNotNull())
    span = [*keys, "start", "stop"]
    spans = written(given.select(*span).distinct())
    longest = spans.agg(F.max(F.col("stop") - F.col("start"))).first()[0] or 1
    cells = []
    for width in range(int(longest).bit_length()):
        # of the whole cells in the interval, the first if its number is odd and the last if it is even: the others pair up in wider cells
        first, after = F.negative(F.shiftright(F.negative(F.col("start")), width)), F.shiftright("stop", width)
        odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
        cells.append(F.when((first < after) & odd(first), F.struct(F.lit(width).alias("width"), first.alias("cell"))))
        cells.append(F.when((first + odd(first).cast("long") < after) & odd(after), F.struct(F.lit(width).alias("width"), (after - 1).alias("cell"))))
    asked = spans.select(*span, F.explode(F.array_compact(F.array(*cells))).alias("at")).select(*span, "at.width", "at.cell")
    widths = sorted(r["width"] for r in asked.select("width").distinct().collect())
    known = points.where(quoted(time).isNotNull()).select(*own, quoted(time).cast("long").alias("time"), *[quoted(c).alias(s) for c, s in zip(sums, totals, strict=True)])
    added = [F.sum(s).alias(s) for s in totals]
    known = written(known.groupBy(*keys, "time").agg(F.count(F.lit(1)).alias("n"), *added))
    each = known.withColumn("width", F.explode(F.array(*map(F.lit, widths)).cast("array<int>"))).withColumn("cell", F.expr("shiftright(time, width)"))
    each = each.groupBy(*keys, "width", "cell").agg(F.sum("n").alias("n"), *added)
    found = attached(asked, each, [*keys, "width", "cell"], most).groupBy(*span).agg(F.sum("n").alias("n"), *added)
    met = attached(given, found, span, most)
    return met.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(intervals.columns)], "n", *[F.col(s).alias(c) for c, s in zip(sums, totals, strict=True)])
