import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabprep.llm import spelling

KIND = "doc_id long, text string"


def brute_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    words, form, out = brute_words(rows), {}, set()
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    for a, n in words.items():
        best = min(near[a], key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 2 * n else None
    for a, n in words.items():
        root = a
        while form[root] is not None:
            root = form[root]
        out.add((a, form[a], root, n, len(near[a]), words[form[a]] if form[a] else None))
    return out


def made(seed, n=500):
    """Texts over few letters, so many words are near each other, with accents and capitals."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abdeé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = list(stems[min(int(rng.expovariate(0.08)), 59)])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice("abdeéÀ")], [w[k], rng.choice("abÿ")]])
            words.append("".join(w).title() if rng.random() < 0.1 else "".join(w))
        rows.append((i, rng.choice([" ", ", ", "\n", "×", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = made(seed) + [(None, "abcde abcde abcde"), (7, None), (8, ""), (9, "abcdé abcdé abcdé"), (9, "abcdé abcdé abcdé")]
    rows += [(2000 + k, "chain" + "xyz"[: k % 4]) for k in range(400) for _ in range(4 ** (k % 4) // 4 + 1)]
    found = {tuple(r) for r in spelling.spelling_groups(spark.createDataFrame(rows, KIND).repartition(3)).collect()}
    due = brute(rows)
    assert found == due
    assert any(f and r != f for _, f, r, *_ in due) and sum(n for *_, n, _ in due) > 100


def test_edges(spark):
    docs = spark.createDataFrame(made(3, 40), KIND)
    assert spelling.spelling_groups(docs.limit(0)).collect() == []
    assert spelling.spelling_groups(spark.createDataFrame([(1, "a bb ccc"), (2, None)], KIND)).collect() == []
    plain = {tuple(r) for r in spelling.spelling_groups(docs).collect()}
    more = docs.select(F.lit(1).alias("word"), F.lit("x").alias("n"), F.col("doc_id").alias("a.id"), F.col("text").alias("my `text`"), F.lit(0).alias("key"))
    assert {tuple(r) for r in spelling.spelling_groups(more, "a.id", "my `text`").collect()} == plain


def test_long_texts_are_read_in_blocks():
    text = "Abc déf" * 50 + "x" * 500 + " ends here"
    for size in (1, 7, 100, 10_000):
        parts = list(spelling.blocks(text, size))
        assert "".join(parts) == text
        assert [w for p in parts for w in re.findall(spelling.RUN, p)] == re.findall(spelling.RUN, text)


def test_a_third_of_all_rows_alike(spark):
    rows = made(4, 60) + [(1000 + k, "hotword hotword hotwird") for k in range(400)]
    assert {tuple(r) for r in spelling.spelling_groups(spark.createDataFrame(rows, KIND)).collect()} == brute(rows)


def test_bands_of_near_words_agree(spark):
    """Every edit of a word leaves a band as it is."""
    pairs = [(w, w[:k] + x + w[k + j :]) for w in ("letter", "éàbcdz") for k in range(6) for j, x in ((1, ""), (0, "q"), (1, "y"), (1, "é"))]
    made_ = spark.createDataFrame(pairs, "a string, b string")
    masks = made_.select(*spelling.band_masks(F.col("a")), *spelling.band_masks(F.col("b"))).collect()
    assert all(any(row[k] == row[k + spelling.BANDS] for k in range(spelling.BANDS)) for row in masks)
