"""Stages return the user's columns as they were, cell by cell, whatever they are called."""

import pytest
from pyspark.sql import functions as F

from tabprep.llm import exact_dedup, mixing, packing, quality, secrets, simhash, substring_dedup
from tabprep.llm.columns import free_names, quoted
from tabprep.llm.queries import tokenizer_path

NAMES = [
    "__k", "__z", "__h", "__n", "__id", "__hash", "__shard", "__copy", "__order", "__sha", "row", "key", "row_key", "short_key", "no_source", "source_name", "bits",
    "shards", "copies", "KEPT", "n", "level", "start", "distance", "base_failed", "a`b", "a.b", "c0", "body", "words", "size", "row_", "ROW_KEY_",
]


def table(spark):
    letters = lambda i, n: " ".join(chr(97 + (i * 7 + k * k) % 26) * (2 + (i + k) % 5) for k in range(n))
    rows = [(i, letters(i // 2, 30 + i % 7 // 3), "en", "ab"[i % 2]) for i in range(60)] + [(7, letters(3, 31), "en", "b")] * 2 + [(None, letters(90, 40), None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return docs.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in NAMES])


@pytest.mark.parametrize("stage", [quality.quality_filter, exact_dedup.exact_dedup, simhash.near_dedup, mixing.mix])
def test_columns_stay(spark, stage):
    docs = table(spark)
    given = set(map(tuple, docs.collect()))
    out = stage(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = list(map(tuple, out.collect()))
    assert rows and set(rows) <= given
    if stage is exact_dedup.exact_dedup:
        assert len(rows) == len(set(rows)) == len({r[1] for r in given})
    if stage is quality.quality_filter:
        assert len(rows) == docs.count()


@pytest.mark.parametrize("most", [0, 1, 1000])
def test_rows_in_doubt_are_settled_either_way(spark, most):
    docs = table(spark)
    judged = exact_dedup.exact_groups(docs)
    found = exact_dedup.keep_rows(docs, judged, most=most)
    keys = [(r["doc_id"], r["text"]) for r in found.collect()]
    best = {}
    for r in docs.collect():
        best[r["text"]] = max(best.get(r["text"], -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert sorted(keys, key=repr) == sorted(((None if k < 0 else k, t) for t, k in best.items()), key=repr)


def test_names(spark):
    docs = spark.createDataFrame([(1, 2)], "a int, `A_` int")
    assert free_names(docs, "a", "a", "b") == ["a__", "a___", "b"]
    assert docs.select(quoted("A_")).columns == ["A_"]


@pytest.mark.parametrize("operator", [secrets.scan, substring_dedup.remove_repeats, simhash.near_groups, exact_dedup.exact_groups, lambda d, **c: packing.token_pieces(d, tokenizer_path(), 2048, 0, **c)])
def test_names_with_dots_and_backticks(spark, operator):
    """Ids and texts are found under any name; the result is that of the usual names."""
    docs = table(spark).select("doc_id", "text")
    other = docs.select(F.col("doc_id").alias("a.id"), F.col("text").alias("my `text`"), F.lit(0).alias("hash"), F.lit("x").alias("text_sha256"))
    found = operator(other, doc_id="a.id", text="my `text`")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, operator(docs, doc_id="doc_id", text="text").collect()))
