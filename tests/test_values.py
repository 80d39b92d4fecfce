import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabprep.operators.roles import column_roles
from tabprep.operators.selectors import low_cardinality
from tabprep.plans.values import few_values, modes, reduced


def shuffled_bytes(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, getattr(sc.statusStore(), "stageList$default$4")(), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.length()))


def brute_mode(values):
    counts = Counter(v for v in values if v is not None)
    return min(counts, key=lambda v: (-counts[v], v), default=None)


def made(seed, n=600):
    rng = random.Random(seed)
    columns = {
        "unique": [f"value {rng.random()}" for _ in range(n)],
        "few": [rng.choice(["a", "b", "é", ""]) for _ in range(n)],
        "tied": [f"t{k % 60}" for k in range(n)],
        "pairs": [f"p{k // 2}" for k in range(n)],
        "skewed": [f"s{min(int(rng.expovariate(0.05)), 400)}" for _ in range(n)],
        "hidden": ["zz" if k % 7 == 0 else f"h{k}" for k in range(n)],
        "late": [f"l{k}" if k < n - 30 else "l3" for k in range(n)],
        "none": [None] * n,
        "holes": [None if k % 3 else rng.choice("xy") for k in range(n)],
        "one.dot`": ["same"] * n,
    }
    rows = list(zip(*columns.values(), strict=True))
    rng.shuffle(rows)
    return columns, rows, ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)


@pytest.mark.parametrize(("held", "survivors"), [(128, 1000), (8, 1000), (8, 2), (1, 1000)])
def test_modes_are_exact(spark, held, survivors):
    columns, rows, kind = made(held)
    df = spark.createDataFrame(rows, kind).repartition(5)
    assert modes(df, list(columns), held, survivors) == {c: brute_mode(v) for c, v in columns.items()}


def test_few_values_are_exact(spark):
    columns, rows, kind = made(3)
    df = spark.createDataFrame(rows, kind).repartition(5)
    for most in (1, 4, 59, 60, 299, 300, 1000):
        n = {c: len(set(v) - {None}) for c, v in columns.items()}
        assert few_values(df, list(columns), most) == {c: k if k <= most else None for c, k in n.items()}


def test_empty_tables_and_no_columns(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert modes(df, ["a", "b"]) == {"a": None, "b": None}
    assert few_values(df, ["a", "b"], 3) == {"a": 0, "b": 0}
    assert modes(df, []) == {} == few_values(df, [], 3)


def test_reduced_counts_keep_their_bound():
    rng = random.Random(1)
    values = [rng.choice("abcdefghij") if rng.random() < 0.6 else str(k) for k in range(2000)]
    for most in (1, 3, 20):
        counts, error = {}, 0
        for v in values:
            counts[v] = counts.get(v, 0) + 1
            error += reduced(counts, most)
        true = Counter(values)
        assert len(counts) <= most and all(counts.get(v, 0) <= true[v] <= counts.get(v, 0) + error for v in true)
        assert error <= len(values) / (most + 1)


def test_no_cells_are_shuffled(spark):
    """Long unique texts decide nothing by moving: their role and mode cost far less shuffle than the texts."""
    df = spark.range(4000, numPartitions=8).select(F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("text"), (F.col("id") % 5).cast("string").alias("few"))
    whole = 4000 * 512
    for use in (lambda: low_cardinality(df, 10).columns, lambda: column_roles(df).ordinal):
        before = shuffled_bytes(spark)
        assert use() == ["few"]
        assert shuffled_bytes(spark) - before < whole / 100
    before = shuffled_bytes(spark)
    assert modes(df, ["text", "few"])["few"] == "0"
    assert shuffled_bytes(spark) - before < whole / 10
