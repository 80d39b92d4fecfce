import re

import numpy as np
import pytest

from tabprep.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, seen, dup, places, again = WORD.findall(text), set(), 0, {}, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in places.values():
        if len(at) > 1:
            again.update(j for i in at for j in range(i, i + 8))
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again), failed


TEXTS = [
    None, "", " \n\t", "one", "a b\na b\n a b\n\na b", "x # * $ % & | < > y", "w " * 40, " ".join(f"w{i % 12}" for i in range(50)),
    "p q r s t u v w " * 2 + "end " + " ".join(f"z{i}" for i in range(60)), "é € 😀 \x0b \x0c \r ü", "\x1c \x85 \xa0", "a\rb\nc\n" * 30,
]


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(n)).capitalize() + "."


def test_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, kept int")
    for r in quality.quality(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(TEXTS[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_chi_square():
    assert quality.chi_square_below(3.841459, 1) == pytest.approx(0.95, abs=1e-6)
    assert quality.chi_square_quantile(0.99, 5) == pytest.approx(15.08627, abs=1e-4)


def test_outliers_go_and_prose_stays(spark):
    rng = np.random.default_rng(3)
    rows = [(i, prose(rng, int(rng.integers(30, 120))), "en" if i % 2 else None, "hot" if i % 3 else "cold") for i in range(500)]
    rows += [(500 + i, " ".join(w + "###" for w in prose(rng, 60).split()), "en", "hot") for i in range(30)]  # less than the quarter that the estimate leaves out
    rows += [(600 + i, prose(rng, 60).upper(), "en", "cold") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    kept = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    assert kept == set(range(500))
    left = quality.quality_filter(docs)
    assert left.columns == docs.columns and left.count() == 500


def test_estimate_is_near_the_clean_moments(spark):
    rng = np.random.default_rng(5)
    clean = rng.normal(0, 1, (800, 5)) * 8 + 60
    dirt = rng.normal(0, 1, (150, 5)) * 2 + 160
    rows = [(0, "a", "b", *np.rint(v).astype(int).tolist(), 1) for v in np.vstack([clean, dirt])]
    kind = "level int, lang string, source string, " + ", ".join(f"{c} long" for c in quality.STATISTICS) + ", n long"
    from tabprep.llm.scratch import Scratch

    found = quality.estimates(spark.createDataFrame(rows, kind), Scratch(spark, "test")).first()
    assert all(abs(found[f"m_{i}"] - 60) < 1.5 for i in range(5))
    assert all(7 < found["l_0_0"] < 12 for _ in range(1))


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    found = quality.quality(docs)
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_small_sources_are_judged_by_themselves(spark):
    rng = np.random.default_rng(7)
    rows = [(i, prose(rng, int(rng.integers(30, 120))), "en", "hot") for i in range(600)]
    rows += [(600 + i, prose(rng, int(rng.integers(30, 120))).upper(), "en", "small") for i in range(60)]
    rows += [(700 + i, " ".join(w + "###" for w in prose(rng, 60).upper().split()), "en", "small") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    assert {r["doc_id"] for r in quality.quality(docs).where("kept").collect()} == set(range(660))


def test_copies_of_junk_are_a_third_of_a_source(spark):
    rng = np.random.default_rng(9)
    rows = [(i, prose(rng, int(rng.integers(30, 120))), "en", "web") for i in range(300)]
    junk = " ".join(w + "#" for w in prose(rng, 60).split())
    rows += [(300 + i, junk, "en", "web") for i in range(150)]
    rows += [(500 + i, " ".join(w + "#" for w in prose(rng, 60).split()), "en", "web") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    assert {r["doc_id"] for r in quality.quality(docs).where("kept").collect()} == set(range(300))


def test_short_repeated_lines_alone_reject(spark):
    rng = np.random.default_rng(13)
    rows = [(i, prose(rng, int(rng.integers(30, 120))), "en", "web") for i in range(300)]
    for i in range(300, 304):
        menu = prose(rng, 30).split()
        rows.append((i, "\n".join(str(x) for x in rng.choice(menu, 300)), "en", "web"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    found = quality.quality(docs).collect()
    assert not any(r["base_failed"] for r in found)
    assert {r["doc_id"] for r in found if r["kept"]} == set(range(300))
