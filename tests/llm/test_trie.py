import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabprep.llm import trie

KIND = "conv_id long, turn long, role string, text string"


def rebuilt(rows, lend):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in turns.items()}
    if not lend:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + ts[h[c] :] for c, ts in own.items()}


def brute(rows, lend=True):
    convs = rebuilt(rows, lend)
    members, below = defaultdict(list), defaultdict(set)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                below[tuple(ts[: d - 1])].add(tuple(ts[:d]))

    def subtree(node):
        yield node
        for child in below[node]:
            yield from subtree(child)

    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    out = set()
    for node, cs in list(members.items()):
        parent = min(members[node[:-1]]) if node else None
        tree = list(subtree(node))
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(node))
        saved = sum((len(members[n]) - 1) * words(n) for n in tree)
        leaves = sum(not below[n] for n in tree)
        out.add((min(cs), len(node), parent, len(cs), len(below[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made(seed, convs=150, most=9):
    rng = random.Random(seed)
    texts = ["", "hello there", "a b c", " x ", "some words of a turn", None]
    rows = []
    for c in rng.sample(range(1000), convs):
        n = rng.randint(1, most)
        rows += [(c, k, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", texts[min(int(rng.expovariate(1)), 5)]) for k in range(n)]
    return rows


def found(conversations, lend=True):
    rows = [tuple(r) for r in trie.conversation_trie(conversations, lend).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("seed", "partitions", "lend"), [(1, 4, True), (2, 31, True), (3, 1, False), (4, 40, False)])
def test_matches_brute_force(spark, seed, partitions, lend):
    rows = made(seed)
    # many tasks, so that spines are stitched over and over
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert found(spark.createDataFrame(rows, KIND), lend) == brute(rows, lend)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_edges(spark):
    rows = [(None, 1, "user", "gone"), (40, None, None, None), (40, 1, "user", "one two"), (41, 1, "user", "one"), (60, 5, "", ""), (60, 6, "", ""), (-20, 1, "a", "b"), (-3, 1, "a", "b c")]
    docs = spark.createDataFrame(rows, KIND)
    assert found(docs) == brute(rows)
    assert found(docs.limit(0)) == set()
    assert trie.conversation_trie(docs.limit(0)).columns == list(trie.RESULT)
    more = docs.select(F.col("conv_id").alias("a.b"), "turn", "role", "text", F.lit(1).alias("name"), F.lit(2).alias("turns"))
    assert {tuple(r) for r in trie.conversation_trie(more, True, "a.b").collect()} == brute(rows)
    # a role may not run into a text
    two = [(1, 1, "ab", "c"), (2, 1, "a", "bc")]
    assert found(spark.createDataFrame(two, KIND), False) == brute(two, False)


def test_repeated_rows_are_turns(spark):
    rows = [(1, 1, "user", "same"), (1, 1, "user", "same"), (2, 1, "user", "same")]
    assert found(spark.createDataFrame(rows, KIND), False) == brute(rows, False)


def test_a_third_of_all_conversations_alike(spark):
    rows = made(5, 60) + [(c, k, "user", f"turn {k}") for c in range(2000, 2200) for k in range(3)] + [(5000, k, "user", f"turn {k % 7}") for k in range(400)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "25")
    try:
        assert found(spark.createDataFrame(rows, KIND), False) == brute(rows, False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_sweep_and_stitch_at_any_cut():
    rng = random.Random(7)
    convs = sorted(([rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 5))], [1] * 5, c) for c in range(60))
    convs = sorted(((n, w[: len(n)], c) for n, w, c in convs), key=lambda x: (x[0], x[2]))
    results = []
    for cuts in ([], [30], [1, 2, 3, 59], list(range(1, 60))):
        parts = [convs[i:j] for i, j in zip([0, *cuts], [*cuts, 60], strict=True)]
        rows = [r for task, part in enumerate(parts) for r in trie.swept(part, task)]
        spine = sorted((r for r in rows if r["kind"] == "spine"), key=lambda r: (r["task"], r["side"], r["depth"]))
        last = list(trie.stitched(spine))
        ids = {r["key"]: r["conv_id"] for r in last}
        keep = [c for c in trie.RESULT if c != "parent_conv_id"]
        whole = [(*[r[c] for c in keep], r.get("parent_conv_id", ids.get(r.get("parent")))) for r in [*(r for r in rows if r["kind"] != "spine"), *last]]
        assert len(whole) == len(set(whole))
        results.append(sorted(whole, key=repr))
    assert all(r == results[0] for r in results)
