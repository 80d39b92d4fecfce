import pytest
from pyspark.sql import functions as F

from tabprep.llm import ranks
from tabprep.llm.components import components
from tabprep.llm.scratch import Scratch


def test_running(spark):
    rows = [("hot" if i % 4 else f"g{i % 3}", i, i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i long, w long").withColumn("key", ranks.hash_key(1, F.col("i")))
    found = ranks.running(df.repartition(5), ["g"], "key", ["i"], "w").collect()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in found if r["g"] == g), key=lambda r: (r["key"], r["i"]))
        assert [r["rank"] for r in own] == list(range(len(own)))
        total = 0
        for r in own:
            assert (r["before"], r["group_rows"], r["group_weight"]) == (total, len(own), sum(x["w"] for x in own))
            total += r["w"]


@pytest.mark.parametrize("hot", [0, 1, 500])
def test_attach(spark, hot):
    rows = spark.range(1000).select(F.when(F.col("id") < hot, 7).otherwise(F.col("id") + 10).alias("k"), F.col("id").alias("v"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"))
    found = {r["v"]: (r["n"], r["least"]) for r in ranks.attach(rows, groups, "k", "n", F.col("v")).collect()}
    assert found == {v: (hot, 0) if v < hot else (1, v) for v in range(1000)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, k) for k in range(101, 190)]
    edges = spark.createDataFrame([*chain, *star, (300, 299), (5, 5), (190, 101)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges, Scratch(spark, "test")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 191)} | {300: 299}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0
