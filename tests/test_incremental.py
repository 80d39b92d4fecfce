import random

import pytest
from pyspark.sql import functions as F

from tabprep.plans.incremental import ProfileStore, sketch_error, sketched_counts, sketches
from tabprep.plans.profile import profile
from tabprep.sources import read_parquet

KIND = "a long, `b.c` double, t string, u string, flag boolean"


def rows(seed, n=200):
    rng = random.Random(seed)
    return [(rng.randint(-(10**rng.randint(0, 12)), 10) if rng.random() < 0.9 else None, rng.choice([rng.random(), float("nan"), None, 2.5]), rng.choice(["x", "y", "é", None]), f"{seed}-{k}", k % 2 == 0) for k in range(n)]


def same(found, due):
    assert found.rows == due.rows and list(found.columns) == list(due.columns)
    for name, p in due.columns.items():
        q = found.columns[name]
        assert (q.type, q.non_null, q.distinct, q.mode, q.low, q.high, q.float_error) == (p.type, p.non_null, p.distinct, p.mode, p.low, p.high, p.float_error), name
        assert q.mean == (None if p.mean is None else pytest.approx(p.mean, rel=1e-12)), name


def test_equals_the_full_profile_after_adds_and_removals(spark, tmp_path):
    def put(k, seed):
        spark.createDataFrame(rows(seed), KIND).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/data/part {k}+")

    def at(*which):
        return [f"{tmp_path}/data/part {k}+" for k in which]

    def due(*which):
        return profile(read_parquet(spark, at(which[0])[0]) if len(which) == 1 else read_parquet(spark, at(which[0])[0]).unionByName(read_parquet(spark, at(which[1])[0])))

    for k in range(3):
        put(k, k)
    store = ProfileStore(spark, f"{tmp_path}/store")
    assert store.version() == 0 and store.profile().rows == 0
    same(store.refit(*at(0, 1)), due(0, 1))
    assert len(store.read) == 2
    same(store.refit(*at(1, 2)), due(1, 2))
    assert len(store.read) == 1 and "part%202" in store.read[0].replace(" ", "%20")
    same(store.refit(*at(1)), due(1))
    assert store.read == [] and store.version() == 3
    put(1, 77)
    same(store.refit(*at(1, 0)), due(1, 0))
    assert len(store.read) == 2
    again = ProfileStore(spark, f"{tmp_path}/store")
    same(again.profile(), due(1, 0))
    n = again.sketched_counts()
    assert set(n) == {"a", "b.c", "t", "u"} and n["t"] == 3
    assert abs(n["u"] - 400) <= 400 * 4 * sketch_error()


def test_a_failed_refit_leaves_the_version_before(spark, tmp_path):
    spark.createDataFrame(rows(1), KIND).write.parquet(f"{tmp_path}/one")
    spark.createDataFrame([("text",)], "a string").write.parquet(f"{tmp_path}/two")
    store = ProfileStore(spark, f"{tmp_path}/store")
    store.refit(f"{tmp_path}/one")
    with pytest.raises(TypeError, match="'a' has several types"):
        store.refit(f"{tmp_path}/one", f"{tmp_path}/two")
    same(store.refit(f"{tmp_path}/one"), profile(read_parquet(spark, f"{tmp_path}/one")))


@pytest.mark.parametrize("n", [0, 1, 500, 60_000])
def test_sketches_merge_within_their_error(spark, n):
    df = spark.range(n).select(F.col("id").alias("a.b"), (F.col("id") % 7).cast("string").alias("seven"))
    # batches overlap, so adding their counts would be wrong
    stored = sketches(df, df.columns).unionByName(sketches(df.where("`a.b` % 3 = 0"), df.columns))
    found = sketched_counts(stored)
    assert abs(found["a.b"] - n) <= 4 * sketch_error() * n
    assert found["seven"] == min(n, 7)
