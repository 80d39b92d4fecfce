import random
from collections import Counter
from itertools import combinations

import pytest

from tabprep.plans.grouped import grouped_profile


def made(n=300):
    rng = random.Random(2)
    pick = lambda *x: rng.choice(x)
    return [(pick("hot", "hot", "hot", "a", None), pick(1, 2, None), pick("x", "y", "z", None), pick(None, float("nan"), 1.5, rng.random()), rng.randint(0, 5), True) for _ in range(n)]


KIND = "`k.1` string, k2 int, t string, x double, i int, flag boolean"


def brute(rows, sets):
    out = {}
    for s in sets:
        groups = {}
        for r in rows:
            groups.setdefault(tuple(r[j] if j in s else None for j in (0, 1)), []).append(r)
        bits = sum(b for j, b in ((0, 2), (1, 1)) if j not in s)
        for key, own in groups.items():
            for name, j in (("t", 2), ("x", 3), ("i", 4)):
                values = [r[j] for r in own if r[j] is not None and r[j] == r[j]]
                counts = Counter(values)
                mode = min(counts, key=lambda v: (-counts[v], v), default=None) if name == "t" else None
                number = name != "t" and values
                out[(*key, bits, name)] = (
                    len(own), len(values), len(counts) if name == "t" else None, pytest.approx(sum(values) / len(values)) if number else None, mode,
                    float(min(values)) if number else None, float(max(values)) if number else None,
                )
    return out


@pytest.mark.parametrize("sets", [None, [("k.1",), ()]])
def test_every_set_matches_brute_force(spark, sets):
    rows = made()
    found = grouped_profile(spark.createDataFrame(rows, KIND).repartition(4), ["k.1", "k2"], sets=sets)
    assert found.columns[:4] == ["k.1", "k2", "grouping", "column"]
    where = [s for n in range(3) for s in combinations((0, 1), n)] if sets is None else [(0,), ()]
    got = {tuple(r[:4]): tuple(r[4:]) for r in found.collect()}
    assert got == brute(rows, where)


def test_edges(spark):
    df = spark.createDataFrame(made(10), KIND)
    assert grouped_profile(df.limit(0), ["k2"]).collect() == []
    only = grouped_profile(df, ["k2"], ["i"], [()]).collect()
    assert len(only) == 1 and only[0]["n_rows"] == 10 and only[0]["mode"] is None
