import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tabprep.llm import substring_dedup


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def some_texts(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 400, n)]
    passages = [word(n) for n in (34, 35, 36, 60, 90)]
    texts = [" ".join(word(10) + passages[k % 5] + word(12)) for k in range(20)]
    texts += [" \t".join(["again"] * 80), " ".join(word(20)), None, "", "\n", " ".join(word(200))]
    return texts + [texts[-1], "é " * 40 + "end"]


def test_levels():
    assert substring_dedup.levels(35) == [18, 35]
    assert substring_dedup.levels(35, 8) == [5, 9, 18, 35]
    assert substring_dedup.levels(5) == [5]


def test_window_hashes_depend_on_the_words_alone():
    one = substring_dedup.word_hashes([b"a", b"b", b"c", b"a", b"b", b"c", b"a"])
    for length in range(1, 8):
        h = substring_dedup.window_hashes(one, length)
        assert len(h) == 8 - length
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == ((one[i : i + length] == one[j : j + length]).all())


@pytest.mark.parametrize(("seed", "window", "first"), [(1, 35, 18), (2, 35, 9), (3, 10, 18)])
def test_matches_brute_force(spark, seed, window, first):
    texts = some_texts(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(3)
    rows = substring_dedup.remove_repeats(docs, window, first).collect()
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}
    assert [found[i] for i in range(len(texts))] == brute(texts, window)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(7, text), (7, text), (None, text), (8, "short")], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs).collect())
    assert found == [(0, 40, 40, ""), (7, 40, 40, ""), (7, 40, 40, ""), (8, 1, 0, "short")]


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
