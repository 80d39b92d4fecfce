import numpy as np
import pytest
import xxhash

from tabprep.llm import simhash
from tabprep.llm.scratch import Scratch


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_roots(values, most=3):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def clustered(rng, n):
    values = set()
    while len(values) < n:
        base = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(int(rng.integers(1, 40))):
            values.add(base)
            for bit in rng.integers(0, 64, int(rng.integers(1, 4))).tolist():
                base ^= 1 << bit
    return sorted(values)[:n]


def test_fingerprint_matches_brute_force():
    for text in ["", " \t\n", "One", "One two", "A b C d e", "Straße Élan ÀB c d", "x y " * 50, "a b c d"]:
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("seed", range(5))
def test_index_finds_the_components_of_all_pairs(seed):
    values = clustered(np.random.default_rng(seed), 300)
    fp = np.array(values, np.uint64)
    index = simhash.GrayIndex(np.zeros(len(fp), np.int64), fp)
    root, by_place = index.roots(), [values[i] for i in index.order]
    expected = brute_roots(by_place)
    assert root.tolist() == expected


def test_groups_in_one_index_stay_apart():
    fp = np.array([5, 5, 7, 7 << 40], np.uint64)
    index = simhash.GrayIndex(np.array([0, 1, 1, 1]), fp)
    groups = [{int(index.order[i]) for i in np.flatnonzero(index.roots() == r)} for r in set(index.roots().tolist())]
    assert sorted(map(sorted, groups)) == [[0], [1, 2], [3]]


@pytest.mark.parametrize("most_in_group", [25, 1 << 18])
def test_components_match_brute_force(spark, most_in_group):
    values = clustered(np.random.default_rng(9), 120)
    rows = [(simhash.signed(v),) for v in values]
    scratch = Scratch(spark, "test")
    links = simhash.near_links(spark.createDataFrame(rows, "fp long"), scratch, most_in_group)
    found = {r["node"]: r["root"] for r in simhash.components(links, scratch).collect()}
    mine = {}
    for (v,) in rows:
        mine.setdefault(found.get(v, v), set()).add(v)
    theirs = {}
    for (v,), r in zip(rows, brute_roots(values), strict=True):
        theirs.setdefault(r, set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_documents(spark):
    rows = [(3, "a b c d e f", 1), (1, "a b c d e f", 2), (2, None, 3), (4, "", 4), (None, "  ", 5), (5, "quite another text it is", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs).collect()}
    mark = lambda t: f"{brute_fingerprint(t):016x}"
    zero = "0" * 16
    assert found == {(3, mark("a b c d e f"), 1), (1, mark("a b c d e f"), 1), (2, zero, 2), (4, zero, 2), (None, zero, 2), (5, mark("quite another text it is"), 5)}
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]


def test_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
