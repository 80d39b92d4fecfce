import hashlib
import re

import pytest

from tabprep.llm import exact_dedup

LONG = "One sentence after another. " * 400
ROWS = [
    (1, "same text", "x"), (2, "same text", "y"), (3, "Same text", None), (4, None, "x"), (5, "", "x"), (6, LONG, "x"), (7, LONG + "!", "x"),
    (8, LONG, "x"), (9, "é" * 9000, "x"), (10, "é" * 9000, "x"), (11, "é" * 8999, "x"), (12, "same text", "x"), (12, "same text", "x"), (None, "alone", "x"),
]


def brute(rows):
    groups = {}
    for key, text, *_ in rows:
        groups.setdefault(text or "", []).append(key)
    out = []
    for text, keys in groups.items():
        top = max((k for k in keys if k is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for k in sorted(keys, key=lambda k: k is None):
            kept = k == top and left == 1
            left -= kept
            out.append((k, top, len(keys), kept, sha))
    return sorted(out, key=repr)


def test_chunks_are_the_whole_text():
    for text in ("", "a", LONG, "x" * 20000, "no stop " * 100 + "\nline\n" * 300):
        parts = re.findall(exact_dedup.chunk_pattern(16, 64), text)
        assert "".join(parts) == text
        assert all(len(p) <= 64 for p in parts)


@pytest.mark.parametrize("bits", [64, 3])
def test_matches_brute_force(spark, bits):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string").repartition(3)
    found = exact_dedup.exact_groups(docs, smallest=16, largest=64, id_bits=bits).drop("n_chunks")
    assert sorted(map(tuple, found.collect()), key=repr) == brute(ROWS)


def test_large_group(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "CASE WHEN id < 500 THEN 'hot' ELSE CAST(id AS STRING) END AS text")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert len(found) == 600
    assert all(found[i] == (499, 500, i == 499) for i in range(500))
    assert all(found[i] == (i, 1, True) for i in range(500, 600))


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, __n string")
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 5, 7, 8, 10, 11, 12]


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = exact_dedup.exact_groups(docs)
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
