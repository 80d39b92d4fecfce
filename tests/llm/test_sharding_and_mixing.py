import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.llm import mixing, sharding

ROWS = [(i, f"text {i} " * (i % 37), ("hot" if i % 3 else None) if i % 5 else f"s{i % 11}") for i in range(700)]
ROWS += [(3, "twice", "hot"), (3, "twice", "hot"), (None, None, "s1"), (900, "", ""), (901, "é €", "")]
KIND = "doc_id long, text string, source string"


def test_shards_hold_the_mixture(spark):
    found = sharding.interleave(spark.createDataFrame(ROWS, KIND).repartition(5)).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in found) == sorted(
        (k or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in ROWS
    )
    shards = {}
    for r in found:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(shards) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    counts = [len(s) for s in shards.values()]
    assert max(counts) - min(counts) <= 1
    sources = {k: s for k, _, s in ROWS}
    # a cut lies within half a row of each source from its share of every source
    slack = len(set(sources.values())) / 2 / len(ROWS)
    by = Counter((sources[r["doc_id"]], r["shard"]) for r in found if r["doc_id"] != 3)
    for source, n in Counter(sources[r["doc_id"]] for r in found if r["doc_id"] != 3).items():
        assert all(abs(by[(source, k)] - n / 8) <= 2 + 2 * n * slack for k in range(8))


def test_shards_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(ROWS, KIND)
    one, other = (sorted(map(repr, map(tuple, sharding.interleave(d).collect()))) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == other
    assert sharding.interleave(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shards", [1, 5, 2000])
def test_any_number_of_shards(spark, shards):
    found = sharding.interleave(spark.createDataFrame(ROWS, KIND), shards).collect()
    assert len({(r["shard"], r["slot"]) for r in found}) == len(ROWS)
    assert all(0 <= r["shard"] < shards for r in found)


def fill_targets(sizes, weights, share=1.5, most=2.0):
    """Targets by resharing, source by source."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if left * weights[i] / total > most * sizes[i]]
        for i in over or open_:
            targets[i] = most * sizes[i] if over else left * weights[i] / total
        if not over:
            break
        left -= sum(targets[i] for i in over)
        open_ -= set(over)
    return targets


@pytest.mark.parametrize("sizes", [[100, 100], [10, 1000, 1000], [0, 0, 7], [5, 4, 3, 2, 1, 900, 0, 17, 8000, 3]])
def test_targets(spark, sizes):
    rows = [(i, n, float((3, 1, 2)[i % 3])) for i, n in enumerate(sizes)]
    found = mixing.with_targets(spark.createDataFrame(rows, "i int, source_size long, weight double"), 1.5, 2.0).orderBy("i").collect()
    assert [r["target"] for r in found] == pytest.approx(fill_targets(sizes, [w for *_, w in rows]))


def test_quotas_are_exact():
    blocks, of_shard = [40, 0, 7, 133, 1, 2_000_000_000], [1, 1_000_000_000, 90, 0, 1_000_000_090]
    quotas = mixing.split_quotas(blocks, of_shard, np.random.default_rng(5))
    assert quotas.sum(axis=0).tolist() == blocks
    assert quotas.sum(axis=1).tolist() == of_shard
    assert quotas.min() >= 0


def test_permutations(spark):
    for bits in range(7):
        t = spark.range(2**bits).selectExpr("id AS block", f"{bits} AS bits", "explode(array('a', 'b')) AS source_name", "false AS no_source")
        places = {}
        for r in t.selectExpr("source_name", f"{mixing.permuted('block', 1, 0)} AS p", f"{mixing.permuted('block', 1, 1)} AS q").collect():
            for turn in "pq":
                places.setdefault((r["source_name"], turn), []).append(r[turn])
        assert all(sorted(p) == list(range(2**bits)) for p in places.values())
        assert bits < 4 or len(set(map(tuple, places.values()))) == 4


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 50)
    docs = spark.createDataFrame(ROWS, KIND).repartition(4)
    found = mixing.mix_plan(docs).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in found) == sorted((k or -1, words(t)) for k, t, _ in ROWS)
    sizes, largest = Counter(), Counter()
    for _, t, s in ROWS:
        sizes[s] += words(t)
        largest[s] = max(largest[s], words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, fill_targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    source_of = {(k, words(t)): s for k, t, s in ROWS}
    taken = Counter()
    for r in found:
        source = source_of[(r["doc_id"], r["size"])]
        assert r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(targets[source])
        assert r["taken"] == r["size"] * r["copies"] and r["copies"] in (0, 1, 2) and len(r["shards"]) == r["copies"]
        taken[source] += r["taken"]
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1
    again = mixing.mix_plan(docs.repartition(2)).collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, map(tuple, found)))


def test_mixture_rows(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], KIND + ", size int")
    plan = Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[r["doc_id"]] += r["copies"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: n for k, n in plan.items() if n})
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_mixture_lies_by_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 50)
    docs = spark.createDataFrame([(i, f"w{i} " * (5 + i % 30), "abc"[i % 3]) for i in range(400)], "doc_id long, text string, source string")
    shard_of = {r["doc_id"]: r["shards"][0] for r in mixing.mix_plan(docs).collect() if len(set(r["shards"])) == 1}
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        mixed = mixing.mix(docs)
        parts = [(r["part"], r["doc_id"]) for r in mixed.withColumn("part", F.spark_partition_id()).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    met = [shard_of[i] for _, i in parts if i in shard_of]
    assert len({p for p, _ in parts}) > 1 and len(set(met)) > 4
    assert met == sorted(met)


def test_taken_follows_from_blocks_and_quotas(spark, monkeypatch):
    """Rebuilds what is taken, and where it goes, from the blocks, their permutations, the needs and the tree's quotas."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 60)
    docs = spark.createDataFrame(ROWS, KIND)
    slim, known = mixing.planned(docs, (3, 1, 2), 1.5, 2.0, 8, 29, "doc_id", "text", "source")
    plan = {(r["no_source"], r["source_name"]): r for r in known.collect()}
    asked = "no_source", "source_name", "bits", "block", "key", "size", "doc_id"
    rows = slim.join(known.select("no_source", "source_name", "bits"), ["no_source", "source_name"]).selectExpr("*", f"shiftright(key, {mixing.KEY_BITS} - bits) AS block")
    rows = rows.selectExpr(*asked, *[f"{mixing.permuted('block', 29, turn)} AS p{turn}" for turn in (0, 1)]).collect()
    expected, quotas = Counter(), Counter()
    for source, info in plan.items():
        own = [r for r in rows if (r["no_source"], r["source_name"]) == source]
        size, drawn = sum(r["size"] for r in own), 0
        assert size == info["source_size"]
        for turn, need in enumerate((min(info["target"], size), max(0, info["target"] - size))):
            total = 0
            for place in range(2 ** info["bits"]):
                block = sorted((r for r in own if r[f"p{turn}"] == place), key=lambda r: r["key"])
                words = sum(r["size"] for r in block)
                if total >= need and need < size or not need:
                    break
                shard = sum(c <= drawn for c in info["cuts"])
                quotas[(source, shard)] += 1
                drawn += 1
                by_key = Counter()
                for r in block:
                    by_key[r["key"]] += r["size"]
                upto, taken_keys = total, set()
                for key in sorted(by_key):
                    if upto + by_key[key] / 2 >= need:
                        break
                    taken_keys.add(key)
                    upto += by_key[key]
                for r in block:
                    if total + words <= need or r["key"] in taken_keys:
                        expected[(r["doc_id"], r["size"], shard)] += 1
                total += words
        assert info["cuts"][-1] == drawn
    found = Counter()
    for r in mixing.mix_plan(docs).collect():
        for shard in r["shards"]:
            found[(r["doc_id"], r["size"], shard)] += 1
    # an empty row's block may be drawn or not where the need is met exactly; all else agrees
    assert {k: n for k, n in found.items() if k[1]} == {k: n for k, n in expected.items() if k[1]}
    totals = Counter()
    for info in plan.values():
        for k, (a, b) in enumerate(zip([0, *info["cuts"]], info["cuts"])):
            totals[k] += b - a
    assert max(totals.values()) - min(totals.values()) <= 1


def test_many_small_sources_spread_over_all_shards(spark):
    rows = [(i, "x", "large") for i in range(3200)] + [(10_000 + i, "x", f"s{i}") for i in range(800)]
    found = sharding.interleave(spark.createDataFrame(rows, KIND)).collect()
    by = Counter(r["shard"] for r in found if r["doc_id"] >= 10_000)
    assert sorted(by) == list(range(8)) and all(60 <= n <= 145 for n in by.values())
    assert Counter(r["shard"] for r in found) == {k: 500 for k in range(8)}


@pytest.mark.parametrize("shards", [3, 8])
def test_shards_match_brute_force(spark, shards):
    key = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)
    slim, n = [], Counter(s for *_, s in ROWS)
    for k, t, s in ROWS:
        crc, size = zlib.crc32((t or "").encode()), len((t or "").encode()) + 1
        slim.append(((s is None, s or ""), key(17, "" if k is None else k, crc, size), k, crc, size))
    ranks, order = Counter(), []
    for stratum, _, k, crc, size in sorted(slim, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3], r[4])):
        rank, rows = ranks[stratum], n[None if stratum[0] else stratum[1]]
        ranks[stratum] += 1
        at = (rank + key(17, "phase", int(stratum[0]), stratum[1]) / 2**52) / rows * 2.0**52
        order.append((min(int(at), 2**52 - 1), stratum, rank, k, crc, size))
    expected = []
    for i, (*_, k, crc, size) in enumerate(sorted(order)):
        shard = i * shards // len(order)
        expected.append((k, crc, size, shard, i - (len(order) * shard + shards - 1) // shards))
    found = sharding.interleave(spark.createDataFrame(ROWS, KIND), shards).select("doc_id", "text_crc32", "size", "shard", "slot").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_draws_from_a_large_population_follow_the_same_law(monkeypatch):
    rng = np.random.default_rng(3)
    for good, bad, number in ((5 * 10**11, 3 * 10**11, 4 * 10**11), (10**10, 7, 10**10), (10**10, 7 * 10**8, 10**9), (0, 10**12, 50), (10**12, 0, 10**11)):
        part, n = good / (good + bad), good + bad
        spread = math.sqrt(number * part * (1 - part) * (n - number) / (n - 1))
        found = np.array([mixing.drawn_from(rng, good, bad, number) for _ in range(400)])
        assert (found >= max(0, number - bad)).all() and (found <= min(good, number)).all()
        assert abs((found - number * part).mean()) <= 5 * spread / 20 + 1e-3
        if spread >= 1:  # seven of ten thousand million and seven stay behind: whole numbers hardly ever vary
            assert 0.8 * spread <= found.std() <= 1.2 * spread
    monkeypatch.setattr(mixing, "POPULATION", 0)
    for few in (0, 3, 32):
        monkeypatch.setattr(mixing, "FEW", few)
        for good, bad, number in ((30, 50, 40), (5, 3, 8), (4, 90, 60), (9, 9, 1)):
            found = np.bincount([mixing.drawn_from(rng, good, bad, number) for _ in range(4000)], minlength=good + 1)
            due = np.array([math.comb(good, k) * math.comb(bad, number - k) if k <= number else 0 for k in range(good + 1)], float) / math.comb(good + bad, number)
            assert found.sum() == 4000 and not found[due == 0].any()
            assert (abs(found - 4000 * due) <= 6 * np.sqrt(4000 * due * (1 - due)) + 4).all()
