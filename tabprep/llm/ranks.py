"""Ranks, running sums and joins that hold when one group has a third of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of ``running`` are long integers from 0 to 2 ** KEY_BITS, exclusive.
KEY_BITS = 52

#: ``attach`` splits groups that have one in PARTS of all rows or more.  ``meet`` broadcasts tables of BROADCAST_ROWS rows at
#: most, and deals rows over SALTS salts where the table is larger.
PARTS, BROADCAST_ROWS, SALTS = 4096, 50_000, 64


def hash_key(*parts: Column | str | int) -> Column:
    """A uniform key for ``running`` from the given values."""
    cols = [F.lit(p) if isinstance(p, (int, str)) else p for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - KEY_BITS)


def digest_key(*parts: Column | str | int) -> Column:
    """A uniform key for ``running`` from the given values without nulls, as 13 digits of an MD5 sum, which SQL engines share."""
    text = F.concat_ws("|", *[F.lit(str(p)) if isinstance(p, (int, str)) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def running(
    table: DataFrame,
    group: list[str],
    key: str,
    ties: list[str],
    weight: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Adds ``rank`` (from 0), ``group_rows`` and, for a weight, ``before`` (sum over earlier rows) and ``group_weight``.

    Rows of a group are ordered by ``key`` and then ``ties``.  The key's leading
    bits cut each group into about sqrt(rows) buckets; rows are ranked in their
    bucket and shifted by the totals of the buckets before it.  So no task gets
    more than about sqrt(rows) rows of a group, whatever its share.  The key must
    be spread evenly; ``group`` must have no nulls.  ``table`` is read twice.
    """
    n = table.count() if rows is None else rows
    bits = max(0, math.ceil(math.log2(max(1, n)) / 2))
    cut = table.withColumn("_bucket", F.shiftright(F.col(key), KEY_BITS - bits))
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    totals = cut.groupBy(*group, "_bucket").agg(*sums)
    of_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = of_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    found = {
        "_first": F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
        "group_rows": F.sum("_n").over(of_group),
    }
    if weight:
        found |= {
            "_sum": F.coalesce(F.sum("_w").over(earlier), F.lit(0)),
            "group_weight": F.sum("_w").over(of_group),
        }
    starts = totals.withColumns(found).drop("_n", "_w")
    inside = Window.partitionBy(*group, "_bucket").orderBy(key, *ties)
    out = {"rank": F.col("_first") + F.row_number().over(inside) - 1}
    if weight:
        upto = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        out["before"] = F.col("_sum") + upto - F.col(weight)
    return cut.join(starts, [*group, "_bucket"]).withColumns(out).drop("_bucket", "_first", "_sum")


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, same: list[str] = ()) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` is a kept table with one row for each ``key`` (a long) and ``same``.

    A group with one in PARTS of all rows or more is joined salted: its rows are
    dealt by ``spread`` over as many salts as it has such parts, and its own row
    is repeated for each.  There are PARTS such groups at most, whatever the
    input, and no salt gets more than one in PARTS of all rows.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    by_key = groups.groupBy(key).agg(F.sum(size).alias("_size"))
    parts = F.ceil(F.col("_size") * PARTS / max(1, total)).cast("int")
    # PARTS keys at most can have so many rows, so they can be broadcast
    hot = by_key.select(key, parts.alias("_parts")).where("_parts > 1")
    if hot.isEmpty():
        return rows.join(groups, [key, *same])
    whole = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), whole).cast("int")).drop("_parts")
    copies = groups.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), whole - 1))).drop("_parts")
    return dealt.join(copies, [key, "_salt", *same]).drop("_salt")


def meet(rows: DataFrame, table: DataFrame, keys: list[str], spread: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined to the kept ``table``, which has one row for each ``keys`` (without nulls).

    The table is broadcast if it has ``most`` rows or fewer.  Beyond that both
    sides are shuffled, the rows dealt by ``spread`` over SALTS salts, as one key
    may have a third of them, and the table's rows repeated for each salt.
    """
    if table.count() <= most:
        return rows.join(F.broadcast(table), keys, how)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
