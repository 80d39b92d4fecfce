import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.llm import phrases
from tabprep.llm.substring_dedup import STEP, mixed

KIND = "doc_id long, text string"
FULL = (1 << 64) - 1


def mix(x):
    return int(mixed(np.array([x & FULL], np.uint64))[0])


def low_bit(a, b):
    return ((a ^ b) & -(a ^ b)).bit_length() - 1


def next_level(symbols, level):
    """Symbol by symbol: runs, four rounds of coin tossing, phrases from peaks, names."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    cap = phrases.LONG_RUN
    flat = [s if n == 1 else s + (min(n, cap) << 21) if level == 0 else mix(s + min(n, cap) * int(STEP)) for s, n in runs]
    labels = flat
    for _ in range(phrases.ROUNDS):
        labels = [2 * (k := 0 if not i else low_bit(labels[i - 1], x)) + (x >> k & 1) for i, x in enumerate(labels)]
    assert max(labels) < 6 and all(a != b for a, b in zip(labels, labels[1:], strict=False))
    cuts = [i for i in range(len(flat)) if not i or i + 1 < len(flat) and labels[i - 1] < labels[i] > labels[i + 1]]
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(flat)], strict=True):
        assert b - a <= 11
        out.append(mix(sum((x + int(STEP)) * pow(int(STEP), k, 1 << 64) for k, x in enumerate(flat[a:b]))))
    return out


def brute_print(text):
    bins, names = [None] * phrases.BINS, set()
    symbols, level = [ord(c) for c in text], 0
    while len(symbols) > 1 or symbols and not level:
        symbols = next_level(symbols, level)
        level += 1
        if level >= phrases.FIRST_LEVEL or len(symbols) == 1:
            names |= set(symbols)
    for name in names:
        seen = mix(name + int(STEP))
        k, rest = seen % phrases.BINS, seen // phrases.BINS
        bins[k] = rest if bins[k] is None else min(bins[k], rest)
    return [0 if b is None else b % 65535 + 1 for b in bins]


def texts(seed, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé€𝄞") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    return [*out, "", "a", "ab", "aaa", "a" * 5000, "ab" * 300, "abc\n" * 50]


def test_prints_match_brute_force():
    given = texts(1)
    assert phrases.prints(given).tolist() == [brute_print(t) for t in given]
    one_by_one = np.concatenate([phrases.prints([t]) for t in given])
    assert (one_by_one == phrases.prints(given)).all()
    assert phrases.prints([]).shape == (0, phrases.BINS)


@pytest.mark.parametrize("size", [70, 200])
def test_pieces_of_names_are_the_same(monkeypatch, size):
    given = texts(2)
    due = phrases.prints(given)
    monkeypatch.setattr(phrases, "NAMED", size)
    phrases.powers.cache_clear()
    assert (phrases.prints(given) == due).all()
    monkeypatch.undo()
    phrases.powers.cache_clear()


def test_shared_passages_are_alike_at_any_offset():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(400))
    alone = phrases.prints([passage])
    for before in ("x", "other words first ", " ".join(word() for _ in range(20)) + " "):
        assert phrases.likeness(alone, phrases.prints([before + passage]))[0] > 0.8
    assert phrases.likeness(alone, phrases.prints([" ".join(word() for _ in range(400))]))[0] < 0.1
    assert phrases.likeness(phrases.prints([""]), phrases.prints([""]))[0] == 1
    assert phrases.likeness(phrases.prints([""]), alone)[0] == 0


def brute(rows):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    import xxhash

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    out = []
    for i, (key, text) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + other[:half]
        a, b, c = (brute_print(t) for t in (text, new, other))
        alike = lambda x, y: sum(p == q != 0 for p, q in zip(x, y, strict=True)) / n if (n := sum(p != 0 or q != 0 for p, q in zip(x, y, strict=True))) else 1.0
        hexed = lambda x: "".join(f"{v:04x}" for v in x)
        out.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), hexed(a), hexed(b), alike(a, b), alike(a, c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_matches_brute_force(spark, parts):
    rows = [(3 * k % 101, t) for k, t in enumerate(texts(4))] + [(7, "tied"), (7, "also tied"), (7, "tied"), (None, "no id"), (None, None), (-5, "below"), (500, "the largest of all ids")]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        docs = spark.createDataFrame(rows, KIND).repartition(3)
        assert sorted(map(tuple, phrases.edited_fingerprints(docs).collect()), key=repr) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_edges(spark):
    docs = spark.createDataFrame([(4, "a single document")], KIND)
    assert [tuple(r) for r in phrases.edited_fingerprints(docs).collect()] == brute([(4, "a single document")])
    assert phrases.edited_fingerprints(docs.limit(0)).collect() == []
    more = docs.select(F.col("doc_id").alias("a.id"), F.col("text").alias("my `text`"), F.lit(1).alias("part"), F.lit("x").alias("key"))
    assert [tuple(r) for r in phrases.edited_fingerprints(more, "a.id", "my `text`").collect()] == brute([(4, "a single document")])


def test_a_third_of_all_rows_alike(spark):
    rows = [(k, f"document {k} of its own words {k * k}") for k in range(60)] + [(30, "the same row")] * 40
    assert sorted(map(tuple, phrases.edited_fingerprints(spark.createDataFrame(rows, KIND)).collect()), key=repr) == brute(rows)


def test_fingerprints_alone(spark):
    docs = spark.createDataFrame([("x", t) for t in texts(5, 5)] + [(None, None)], "doc_id string, text string")
    due = sorted(("x", len(t), "".join(f"{v:04x}" for v in brute_print(t))) for t in texts(5, 5)) + [(None, 0, "0" * 4 * phrases.BINS)]
    assert sorted(map(tuple, phrases.fingerprints(docs).collect()), key=lambda r: (r[0] is None, r[1:])) == sorted(due, key=lambda r: (r[0] is None, r[1:]))
