import pytest
from pyspark.sql import types as T

from tabprep.functions import leading_number, leading_unit, quoted
from tabprep.operators import (
    column_roles, drop_columns, low_cardinality, n_unique, numeric_columns, pick, shrink, shrink_plan, text_columns, text_except,
    text_except_dates, wide_numeric,
)
from tabprep.plans import Catalogue, profile
from tabprep.sources import without_nan

MEASURES = [
    ("100 g", 100.0, "g"), ("1,5 L", 1.0, "L"), ("-5 kg", 5.0, "kg"), ("abc", None, "abc"), ("", None, ""), (None, None, ""),
    ("6 x 100 g", 6.0, "x"), ("100.", 100.0, ""), ("1.5.2 L", 1.5, "L"), ("µg 30 é", 30.0, "g"),
]


def test_measures(spark):
    df = spark.createDataFrame([(m,) for m, _, _ in MEASURES], "m string")
    found = df.select(leading_number(quoted("m")), leading_unit(quoted("m"))).collect()
    assert [tuple(r) for r in found] == [(n, u) for _, n, u in MEASURES]


def test_digits_of_other_scripts(spark):
    df = spark.createDataFrame([("٣٫٥ و ٤٢",), ("१२.५ kg",), ("7",)], "m string")
    assert [r[0] for r in df.select(leading_number(quoted("m"), any_digits=True)).collect()] == [3.0, 12.5, 7.0]
    assert [r[0] for r in df.select(leading_number(quoted("m"))).collect()] == [None, None, 7.0]


def test_nan_becomes_missing(spark):
    df = without_nan(spark.createDataFrame([(x,) for x in (1.0, float("nan"), None, -1.0, 0.0, float("inf"))], "x double"))
    assert df.where("x IS NULL").count() == 2
    assert df.where("x >= 0").count() == 3
    assert n_unique(df, "x") == 4


def test_modes_and_distinct_counts(spark):
    rows = [("b", "é", "x"), ("a", "z", None), ("b", "Z", None), ("a", None, None), ("c", None, None), (None, None, None)]
    known = profile(spark.createDataFrame(rows, "ties string, order string, sparse string").repartition(3))
    assert (known.columns["ties"].mode, known.columns["ties"].distinct) == ("a", 3)
    assert known.columns["order"].mode == "Z"
    assert known.null_fraction("sparse") == pytest.approx(5 / 6)


@pytest.mark.parametrize("parts", [1, 8])
def test_profile_is_one_action_and_partition_independent(spark, parts):
    df = spark.range(100).selectExpr("id", "CAST(id AS DOUBLE) / 7 AS x", "CAST(id % 5 AS STRING) AS t", "id % 2 = 0 AS b").repartition(parts)
    known = profile(df)
    assert known.rows == 100
    assert (known.columns["id"].low, known.columns["id"].high) == (0, 99)
    assert round(known.columns["x"].mean, 9) == round(99 / 14, 9)
    assert (known.columns["t"].mode, known.columns["t"].distinct) == ("0", 5)
    assert known.columns["b"].mean is None and known.columns["b"].non_null == 100


def test_empty_table(spark):
    df = spark.createDataFrame([], "a long, x double, t string")
    known = profile(df)
    assert known.rows == 0 and known.null_fraction("a") == 0 and known.columns["t"].distinct == 0
    assert [type(n.after) for n in shrink_plan(known)] == [T.ByteType, T.FloatType]


def test_profile_of_awkward_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], "`a.b` long, `energy-kj_100g` string, `tick``ed` string")
    assert list(profile(df).columns) == df.columns
    assert shrink(df).columns == df.columns
    assert pick(df, ["a.b"]).columns == ["a.b"]


@pytest.mark.parametrize(
    ("low", "high", "kind"),
    [(-128, 127, T.ByteType), (0, 128, T.ShortType), (-129, 0, T.ShortType), (0, 32768, T.IntegerType), (0, 1 << 31, T.LongType), (None, None, T.ByteType)],
)
def test_integers_shrink(spark, low, high, kind):
    df = spark.createDataFrame([(low,), (high,), (None,)], "a long")
    assert isinstance(shrink(df).schema["a"].dataType, kind)


@pytest.mark.parametrize(
    ("value", "kind"),
    [(1.5, T.FloatType), (123456.789, T.FloatType), (68423.4625, T.DoubleType), (1e300, T.DoubleType), (float("inf"), T.FloatType), (None, T.FloatType)],
)
def test_doubles_shrink_within_the_tolerance(spark, value, kind):
    df = spark.createDataFrame([(value,), (None,)], "x double")
    assert isinstance(shrink(df).schema["x"].dataType, kind)


def test_other_widths_are_left_alone(spark):
    df = spark.createDataFrame([(1, 2, True)], "a int, b long, c boolean")
    assert [f.dataType.simpleString() for f in shrink(df).schema] == ["int", "tinyint", "boolean"]
    assert numeric_columns(df) == ["a", "b"]
    assert wide_numeric(df).columns == ["b"]


NAMES = "`Date` string, `date` string, `energy-kj_100g` double, `a.b` string, `LastUPDATE` string, created_t string, candidate_x string"


def test_selectors(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([], NAMES)
        assert text_except_dates(df, []).columns == ["a.b", "created_t"]
        assert text_except(df, ["a.b", "absent"]).columns == ["Date", "date", "LastUPDATE", "created_t", "candidate_x"]
        assert pick(df, ["date", "Date"]).columns == ["date", "Date"]
        assert pick(df, ["DATE"]) is None
        assert pick(df, []).columns == []
        assert drop_columns(df, ["Date", "absent"]).columns == df.columns[1:]
        assert text_columns(df) == [c for c in df.columns if c != "energy-kj_100g"]
        assert n_unique(df, "DATE") is None
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_roles(spark):
    rows = [(str(i % 3), str(i), i, i % 2 == 0, [i]) for i in range(20)]
    df = spark.createDataFrame(rows, "few string, many string, n long, flag boolean, nested array<int>")
    report = column_roles(df, 10)
    assert (report.numeric, report.ordinal, report.non_ordinal) == (["n"], ["few"], ["many"])
    assert report.table.columns == df.columns
    assert [tuple(r) for r in report.rows().collect()] == [(0, "few", "ordinal"), (1, "many", "non_ordinal"), (2, "n", "numeric")]
    assert low_cardinality(df, 3).columns == ["few"]


def test_catalogue(spark, capsys):
    df = spark.createDataFrame([(1, 0.5, "a", "x"), (2, None, "b", "x")], "n long, x double, update_t string, u string")
    held = Catalogue(df)
    assert held.wide_numeric().columns == ["n", "x"]
    assert held.pick(["n", "missing"]) is None
    assert held.text_except_dates([]).columns == ["u"]
    assert held.low_cardinality(1).columns == ["u"]
    assert held.describe_unique("u") == "'u' has 1 values" and "no column" in held.describe_unique("zz")
    assert [tuple(r) for r in held.info().select("column", "non_null", "n_rows").collect()] == [("n", 2, 2), ("x", 1, 2), ("update_t", 2, 2), ("u", 2, 2)]
    held.shrink()
    assert held.wide_numeric().columns == []
    assert [r["type"] for r in held.types().collect()] == ["int8", "float32", "text", "text"]
    held.show(1)
    assert "update_t" in capsys.readouterr().out
    assert held.head(1).count() == 1


def test_counts_only(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (None, None, 2.0), (3, None, None)], "n long, `t.x` string, d double")
    known = profile(df, counts_only=True)
    assert known.rows == 3 and {c: p.non_null for c, p in known.columns.items()} == {"n": 2, "t.x": 1, "d": 2}
    assert all(p.distinct is p.mean is p.mode is p.low is p.float_error is None for p in known.columns.values())
    assert profile(df.where("n < 0"), counts_only=True).null_fraction("d") == 0.0
