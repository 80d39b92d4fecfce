import random
import re

import pytest
from pyspark.sql import functions as F

from tabprep.operators.timed import asof_join, interval_join, interval_totals


def made(seed, n):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", "a", "b", None, "c"])
    return [(key(), rng.choice([None, *range(60)]), rng.choice([None, rng.randint(0, 9)]), k) for k in range(n)]


def brute_asof(left, right):
    out = []
    for k, t, v, i in left:
        fits = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        best = max(fits, key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3]), default=(None,) * 4)
        out.append((k, t, v, i, *best[1:]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("most", "cells"), [(10**6, 200), (30, 5), (1, 7)])
def test_asof_matches_brute_force(spark, most, cells):
    left, right = made(1, 150), made(2, 120)
    kind = "`k.1` string, t long, v long, i long"
    found = asof_join(spark.createDataFrame(left, kind).repartition(3), spark.createDataFrame(right, kind), ["k.1"], "t", "r_", most, cells)
    assert found.columns == ["k.1", "t", "v", "i", "r_t", "r_v", "r_i"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_asof(left, right)


def test_asof_with_empty_sides(spark):
    kind = "k string, t long, v long, i long"
    some, none = spark.createDataFrame(made(3, 20), kind), spark.createDataFrame([], kind)
    assert asof_join(none, some, ["k"], "t").count() == 0
    alone = asof_join(some, none, ["k"], "t").collect()
    assert len(alone) == 20 and all(r["right_i"] is None for r in alone)


@pytest.mark.parametrize("most", [10**6, 4])
def test_intervals_match_brute_force(spark, most):
    rng = random.Random(4)
    points = [(rng.choice("hhhab"), rng.choice([None, *range(-50, 300)]), k) for k in range(120)]
    intervals = [(rng.choice(["h", "a", None]), s := rng.randint(-60, 300), rng.choice([None, s, s + 1, s + 3, s + 64, s + 1000]), k) for k in range(60)]
    due = sorted((p[0], p[1], p[2], *i[1:]) for p in points for i in intervals if p[0] == i[0] and p[1] is not None and i[2] is not None and i[1] <= p[1] < i[2])
    found = interval_join(spark.createDataFrame(points, "k string, t long, n long"), spark.createDataFrame(intervals, "k string, s long, e long, n long"), ["k"], "t", "s", "e", most=most)
    assert found.columns == ["k", "t", "n", "in_s", "in_e", "in_n"]
    assert sorted(map(tuple, found.collect())) == due and len(due) > 100
    assert interval_join(found.limit(0).select("k", "t"), spark.createDataFrame(intervals, "k string, s long, e long, n long"), ["k"], "t", "s", "e").count() == 0


@pytest.mark.parametrize("most", [10**6, 4])
def test_interval_totals_match_brute_force(spark, most):
    rng = random.Random(6)
    points = [(rng.choice(["h", "h", "a", "b", None]), rng.choice([None, *range(-50, 300)]), rng.choice([None, 0.5, 2.0, 3.25])) for _ in range(150)]
    intervals = [(rng.choice(["h", "a", None]), s := rng.choice([None, *range(-60, 300)]), s if s is None else rng.choice([None, s - 1, s, s + 1, s + 3, s + 64, s + 1000]), k) for k in range(90)]
    intervals += [("h", -7, 30, k) for k in range(90, 110)]
    due = []
    for i in intervals:
        met = [p[2] for p in points if p[0] == i[0] is not None and None not in (p[1], i[1], i[2]) and i[1] <= p[1] < i[2]]
        if met:
            due.append((*i, len(met), sum(v for v in met if v is not None) if any(v is not None for v in met) else None))
    given = spark.createDataFrame(intervals, "`k.1` string, s long, e long, n_ long")
    found = interval_totals(spark.createDataFrame(points, "`k.1` string, t long, v double"), given, ["k.1"], "t", "s", "e", ["v"], most=most)
    assert found.columns == ["k.1", "s", "e", "n_", "n", "v"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(due, key=repr) and len(due) > 40


def test_interval_sums_makes_no_row_for_each_pair(spark, tmp_path):
    """4,000 orders of one customer and one day make 16,000,000 pairs; no join compares times any more."""
    from tabprep.queries import QUERIES

    rows = spark.range(4000).selectExpr("id AS o_orderkey", "7L AS o_custkey", "timestamp_ntz'1995-01-01 00:00:00' AS o_orderdate", "1.5D AS o_totalprice")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["interval_sums"](spark, str(tmp_path))
    assert set(map(tuple, found.select("n", "total").distinct().collect())) == {(4000, 6000.0)} and found.count() == 4000
    assert not re.search(r"start#\d+L? <= time#", found._jdf.queryExecution().optimizedPlan().toString())


def test_a_hot_key_lies_in_several_partitions(spark):
    """The window over a hot key's rows is partitioned by its cells as well."""
    rows = spark.range(3000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    found = asof_join(rows, rows, ["k"], "t", most=500, cells=20)
    assert found.where("right_v = v").count() == 3000
    assert "cell" in found._jdf.queryExecution().optimizedPlan().toString().split("windowspecdefinition(")[1][:40]
