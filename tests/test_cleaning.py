import pytest

from tabprep.plans import Cleaner
from tabprep.streaming import clean_files

SCHEMA = "url string, serving_size string, quantity string, energy_100g double, n long, half long, flag boolean"
ROWS = [
    ("u", "100 g", "1 L", 5.0, 1, 1, True),
    ("u", "100 g", "2 L", None, None, None, None),
    ("u", None, "2 L", -1.0, 4, None, False),
    ("u", "0 g", None, 9.0, 3, 2, True),
]


def test_cleaning(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = Cleaner().fit(df)
    out = model.transform(df)
    assert out.columns == [
        "serving_size", "quantity", "energy_100g", "n", "flag", "serving_size_value", "serving_size_unit", "quantity_value", "quantity_unit",
    ]
    rows = {r["quantity_value"]: r for r in out.collect()}
    assert sorted(rows) == [1.0, 2.0]
    filled = rows[2.0]
    assert filled["energy_100g"] == pytest.approx(13 / 3)
    assert filled["n"] == pytest.approx(8 / 3)
    assert filled["flag"] is None


def test_exactly_half_missing_is_dropped(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert "half" not in Cleaner().fit(df).kept
    assert "half" in Cleaner(required=["half"]).fit(df).kept


def test_filled_text_is_extracted(spark):
    df = spark.createDataFrame([("7 g", "1 L", 1.0), ("7 g", "1 L", 1.0), (None, "3 L", 1.0)], "serving_size string, quantity string, energy_100g double")
    out = Cleaner().fit(df).transform(df)
    assert [r["serving_size_value"] for r in out.collect()] == [7.0, 7.0, 7.0]


def test_faults_name_the_column(spark):
    base = "serving_size string, quantity string, energy_100g double"
    with pytest.raises(ValueError, match="quantity"):
        Cleaner().fit(spark.createDataFrame([("1 g", None, 1.0), ("1 g", None, 1.0)], base))
    with pytest.raises(ValueError, match="energy_100g"):
        Cleaner().fit(spark.createDataFrame([("1 g", "1 g")], "serving_size string, quantity string"))
    with pytest.raises(TypeError, match="quantity"):
        Cleaner().fit(spark.createDataFrame([("1 g", 1.0, 1.0)], "serving_size string, quantity double, energy_100g double"))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert Cleaner().fit(df).transform(df).count() == 0


def test_excluded_columns_are_not_filled(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = Cleaner(exclude=["n"]).fit(df).transform(df)
    assert {r["n"] for r in out.collect()} == {1, None}


def test_stream_of_files(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = Cleaner().fit(df)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(2):
        df.write.mode("append").parquet(source)
        clean_files(spark, model, df.schema, source, target, str(tmp_path / "seen")).awaitTermination(120)
        assert spark.read.parquet(target).count() == (part + 1) * model.transform(df).count()


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan, "a"), (nan, nan, "a"), (3.0, 1.0, None), (2.0, nan, "b")], "x double, sparse double, t string")
    model = Cleaner(measures=(), non_negative=("x",)).fit(df)
    assert model.kept == ["x", "t"]
    assert sorted(r["x"] for r in model.transform(df).collect()) == [1.0, 2.0, 2.0, 3.0]
