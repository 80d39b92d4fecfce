import duckdb
import pytest

import corpus_pipeline

from tabprep.llm.queries import ORACLE_SQL, QUERIES

from .test_quality import brute
from .test_simhash import brute_fingerprint, brute_roots

SF = "/root/testdata/sf0.001"


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        given = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == set(given)
            break
        assert docs.columns == columns
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(given[k] == t for k, t in kept.items())
        if name == "quality rules":
            assert not any(brute(t)[-1] for t in kept.values())
        elif name == "exact dedup":
            assert set(kept) == {max(k for k, u in given.items() if u == t) for t in given.values()}
        elif name == "near dedup":
            keys = sorted(given)
            roots = brute_roots([brute_fingerprint(given[k]) for k in keys])
            assert set(kept) == {min(k for k, r in zip(keys, roots, strict=True) if r == one) for one in set(roots)}


def test_run_is_repeatable(spark):
    one, other = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert one and one == other


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = con.sql(ORACLE_SQL[name]).project(", ".join(columns)).fetchall()
    assert sorted(map(tuple, mine.select(*columns).collect())) == sorted(theirs)


def test_every_operator_is_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 11))
