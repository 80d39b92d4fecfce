import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tabprep.plans.quantiles import capped, exact_quantiles, scale

SHARES = [0.0, 0.001, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def columns(n=997):
    rng = random.Random(5)
    return {
        "normal": [rng.gauss(0, 1) for _ in range(n)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)],
        "near": [1 + k * 2.0**-52 for k in range(n)],
        "tied": [float(rng.randint(-2, 2)) for _ in range(n)],
        "huge": [rng.choice([-1.7e308, 1.7e308, 5e-324, -5e-324, 0.0, math.inf, -math.inf]) for _ in range(n)],
        "holes": [None if k % 3 else float(k) for k in range(n)],
        "none": [None] * n,
    }


@pytest.mark.parametrize("cuts", [4, 1 << 14])
def test_same_as_sql(spark, cuts):
    given = columns()
    kind = ", ".join(f"{c} double" for c in given)
    df = spark.createDataFrame(list(zip(*given.values(), strict=True)), kind).repartition(5)
    found = exact_quantiles(df, given, SHARES, cuts)
    frame = df.toPandas().astype(float)  # noqa: F841
    for c, values in given.items():
        if c == "none":
            assert found[c] == [None] * len(SHARES)
            continue
        due = duckdb.sql(f"SELECT quantile_disc({c}, {SHARES}) FROM frame WHERE NOT isnan({c})" if c == "holes" else f"SELECT quantile_disc({c}, {SHARES}) FROM frame").fetchall()[0][0]
        assert found[c] == due, c


def test_scale_never_falls(spark):
    values = sorted({x for c in columns().values() for x in c if x is not None} | {2.0**k for k in range(-1074, 1024)} | {math.nextafter(2.0**k, 0) for k in range(-1000, 1024)})
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(scale(F.col("x"))).collect()]
    assert got == sorted(got)


def test_capping(spark):
    df = spark.createDataFrame([(k, float(k), None if k else float("nan"), "t") for k in range(101)], "`a.b` long, x double, y double, t string")
    rows = capped(df, low=0.1, high=0.9).orderBy("x").collect()
    assert capped(df).dtypes == df.dtypes
    assert [r["a.b"] for r in rows] == sorted(min(max(k, 10), 90) for k in range(101)) and {r["y"] for r in rows} == {None}
    only = capped(df, ["x"], 0.1, 0.9)
    assert only.agg(F.max("`a.b`")).first()[0] == 100 and only.agg(F.max("x")).first()[0] == 90
    assert capped(df.limit(0)).count() == 0
    assert exact_quantiles(df, [], [0.5]) == {} and exact_quantiles(df, ["x"], []) == {"x": []}
