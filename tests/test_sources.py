import gzip

import pytest

from tabprep.sources import NULL_TOKENS, read_delimited, read_parquet, read_split, staged
from tabprep.sources.delimited import unique_names
from tabprep.sources.staging import shared_folder

LINES = 'a\tb\tc\tn\tx\tflag\td\n1\t"a ""q"" b"\tu\t1\t0.5\tTrue\t2024-01-01\nlong\t1\t2\t3\t4\t5\t6\t7\n2\tshort\n3\t"two\nlines\tin"\tw\t4\tinf\tFalse\t2024-01-02\n\n'


@pytest.fixture
def tsv(tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(LINES)
    return str(path)


def test_long_lines_are_skipped_and_short_ones_padded(spark, tsv):
    rows = read_delimited(spark, tsv, bad_lines="skip").collect()
    assert [r["a"] for r in rows] == [1, 2, 3]
    assert [r["b"] for r in rows] == ['a "q" b', "short", "two\nlines\tin"]
    assert rows[1]["c"] is None and rows[2]["x"] == float("inf")


def test_types(spark, tsv):
    df = read_delimited(spark, tsv, bad_lines="skip")
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "string", "n": "double", "x": "double", "flag": "string", "d": "string"}
    first = read_delimited(spark, tsv, bad_lines="skip", limit=1)
    assert dict(first.dtypes)["flag"] == "boolean" and first.count() == 1


def test_long_lines_raise(spark, tsv):
    with pytest.raises(ValueError, match="more than 7 fields"):
        read_delimited(spark, tsv)
    with pytest.raises(ValueError, match="bad_lines"):
        read_delimited(spark, tsv, bad_lines="guess")


def test_null_tokens(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("k\tv\tw\n" + "".join(f"{i}\t{t}\t\n" for i, t in enumerate(NULL_TOKENS)) + "99\tword\t\n")
    df = read_delimited(spark, str(path))
    assert df.where("v IS NULL").count() == len(NULL_TOKENS) == 19
    assert dict(df.dtypes) == {"k": "bigint", "v": "string", "w": "double"}


def test_numbers(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("big\tplain\tsuffix\texp\n9223372036854775808\t7\t1d\t1e5\n1\t-8\t2\t-Infinity\n")
    df = read_delimited(spark, str(path))
    assert dict(df.dtypes) == {"big": "double", "plain": "bigint", "suffix": "string", "exp": "double"}
    assert [r["exp"] for r in df.collect()] == [1e5, float("-inf")]


def test_compressed_and_repeated_names(spark, tmp_path):
    path = tmp_path / "t.csv.gz"
    with gzip.open(path, "wt") as out:
        out.write("a\ta\tb.c\n1\t2\tx\n")
    df = read_delimited(spark, str(path))
    assert df.columns == ["a", "a.1", "b.c"]
    assert tuple(df.first()) == (1, 2, "x")


def test_unique_names():
    assert unique_names(["a", "a", "b", "a"]) == ["a", "a.1", "b", "a.2"]
    assert len(set(unique_names(["a", "a.1", "a"]))) == 3


def test_parquet(spark, tmp_path):
    path = str(tmp_path / "food.parquet")
    spark.createDataFrame([(1, float("nan")), (2, 0.5)], "a long, x double").write.parquet(path)
    assert [r["x"] for r in read_parquet(spark, path).orderBy("a").collect()] == [None, 0.5]
    assert read_split(spark, "food", {"food": "food.parquet"}, str(tmp_path)).count() == 2
    with pytest.raises(KeyError, match="beauty"):
        read_split(spark, "beauty", {"food": "food.parquet"})
    assert staged(spark, path) == path


def test_files_from_the_web(spark, tmp_path):
    """A server on this machine stands for the web."""
    import gzip
    import threading
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    (tmp_path / "web").mkdir()
    with gzip.open(tmp_path / "web" / "t.tsv.gz", "wt", encoding="utf-8") as f:
        f.write("a\tb\n1\tx\n2\té\n")
    quiet = type("Quiet", (SimpleHTTPRequestHandler,), {"log_message": lambda *a: None})
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(quiet, directory=str(tmp_path / "web")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/t.tsv.gz"
        df = read_delimited(spark, url, limit=2, folder=f"file://{tmp_path}/shared")
        assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, "x"), (2, "é")]
        assert list((tmp_path / "shared").glob("fetched-*/t.tsv.gz"))
        assert read_delimited(spark, url).count() == 2
    finally:
        server.shutdown()


def test_a_bad_line_beyond_the_limit_is_not_looked_at(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("a\tb\n1\t2\n3\t4\n5\t6\t7\n")
    assert read_delimited(spark, str(path), limit=2).count() == 2
    with pytest.raises(ValueError, match="more than 2"):
        read_delimited(spark, str(path), limit=3)
    assert read_delimited(spark, str(path), limit=3, bad_lines="skip").count() == 2


def test_shared_folder(spark, tmp_path):
    assert shared_folder(spark, f"{tmp_path}/") == str(tmp_path)
    assert shared_folder(spark)
