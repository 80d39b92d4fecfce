import pytest

from tabprep.plans import Catalogue


@pytest.fixture
def held(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("n\tkind\tnote\n" + "".join(f"{k}\t{'ab'[k % 2]}\tnote {k}\n" for k in range(30)) + "30\tb\tx\ttoo\tlong\n" + "".join(f"{k}\tc\tlast\n" for k in range(31, 40)))
    return lambda n=10_000: Catalogue.read(spark, str(path), n)


def test_the_first_rows_of_a_file_without_its_long_lines(held):
    assert held().table.count() == 39
    first = held(31).table
    assert sorted(r["n"] for r in first.collect()) == [*range(30), 31]
    assert first.dtypes == [("n", "bigint"), ("kind", "string"), ("note", "string")]


def test_head_and_show(held, capsys):
    catalogue = held(3)
    assert len(catalogue.head(2).collect()) == 2 and catalogue.head().count() == 3
    catalogue.show(3)
    printed = capsys.readouterr().out
    assert "|n  |kind|note  |" in printed and all(f"|{k}  |{'ab'[k % 2]}   |note {k}|" in printed for k in range(3))


def test_reports(held):
    catalogue = held()
    assert catalogue.describe_unique("kind") == "'kind' has 3 values"
    assert catalogue.describe_unique("absent") == "no column 'absent'"
    assert [tuple(r) for r in catalogue.types().orderBy("position").collect()] == [(0, "n", "int64"), (1, "kind", "text"), (2, "note", "text")]
    assert [tuple(r) for r in catalogue.info().orderBy("position").collect()] == [(0, "n", "int64", 39, 39), (1, "kind", "text", 39, 39), (2, "note", "text", 39, 39)]
    assert catalogue.low_cardinality(3).columns == ["kind"]
    assert catalogue.roles().ordinal == ["kind"] and catalogue.roles(2).ordinal == []


def test_narrowing_replaces_the_held_table(held):
    catalogue = held()
    assert catalogue.wide_numeric().columns == ["n"]
    assert dict(catalogue.shrink().dtypes)["n"] == "tinyint"
    assert catalogue.wide_numeric().columns == [] and catalogue.table.count() == 39
