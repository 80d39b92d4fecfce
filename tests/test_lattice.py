import random

import pytest

from tabprep.sources import read_delimited, read_delimited_files
from tabprep.sources.lattice import KINDS, joined_kind

CELLS = {"long": ["1", " -2 ", "+30"], "double": ["1.5", "1e5", "7", "-Infinity", "9223372036854775808"], "boolean": ["True", "false"], "text": ["x", "2024-01-01", "1d"], "empty": [""]}


def put(folder, kinds, rng, missing=0.0):
    """A file with a column for each kind."""
    folder.mkdir(exist_ok=True)
    rows = [[rng.choice(CELLS[k]) if rng.random() >= missing else "NA" for k in kinds] for _ in range(8)]
    rows += [[CELLS[k][0] if missing == 0 else "" for k in kinds]]
    n = len(list(folder.iterdir()))
    (folder / f"{n:02} file.tsv").write_text("\n".join("\t".join(r) for r in [[f"c{i}" for i in range(len(kinds))], *rows]) + "\n")


@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_equals_inference_over_all_files_together(spark, tmp_path, missing):
    rng, pairs = random.Random(1), [(a, b) for a in KINDS for b in KINDS]
    for side in (0, 1):
        put(tmp_path / "d", [p[side] for p in pairs], rng, missing)
    table, found = read_delimited_files(spark, str(tmp_path / "d"))
    whole = read_delimited(spark, str(tmp_path / "d"))
    assert table.dtypes == whole.dtypes
    assert sorted(map(repr, table.collect())) == sorted(map(repr, whole.collect()))


def test_conflicts_name_file_and_value(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.tsv").write_text("n\tm\tflag\n1\t1\tTrue\n2\t2\tTrue\n")
    (tmp_path / "d" / "b.tsv").write_text("n\tm\tflag\n3\t3\tFalse\nnone\t4\tTrue\n")
    (tmp_path / "d" / "c.tsv").write_text("n\tm\tflag\n3.5\tNA\t\n4\tNA\tTrue\n")
    table, found = read_delimited_files(spark, str(tmp_path / "d"))
    rows = sorted((r["column"], r["file"].rsplit("/", 1)[1], r["kind"], r["value"]) for r in found.collect())
    assert rows == [("n", "a.tsv", "long", None), ("n", "b.tsv", "text", "none"), ("n", "c.tsv", "double", "3.5")]
    assert dict(table.dtypes) == {"n": "string", "m": "double", "flag": "string"}
    with pytest.raises(ValueError, match="more than 3"):
        (tmp_path / "d" / "d.tsv").write_text("n\tm\tflag\n1\t2\t3\t4\n")
        read_delimited_files(spark, str(tmp_path / "d"))
    assert read_delimited_files(spark, str(tmp_path / "d"), bad_lines="skip")[0].count() == 6


def test_no_rows(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n")
    table, found = read_delimited_files(spark, str(tmp_path / "t.tsv"))
    assert table.columns == ["a", "b"] and table.count() == 0 == found.count()


def test_joined_kind():
    for a in KINDS:
        assert joined_kind({a, "empty"}, True) == joined_kind({a}, True)
        assert joined_kind({a, "text"}, False) == "text"
    assert joined_kind({"long", "double"}, False) == "double"
    assert joined_kind({"long"}, False) == "long" and joined_kind({"boolean"}, False) == "boolean"
    assert joined_kind({"long", "boolean"}, False) == "text"
