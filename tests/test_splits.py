import csv
import gzip
import io
import random

import pytest

from tabprep.sources import read_delimited, splits

SPLITS = [11, 60, 1 << 20]


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Sets how many bytes a split of the text has; what is written from it is read in larger ones."""
    write = splits.Staged.written

    def set_(n):
        def written(self, table, name):
            if name == "pieces":
                spark.conf.set("spark.sql.files.maxPartitionBytes", f"{n}b")
                spark.conf.set("spark.sql.files.openCostInBytes", "1")
            try:
                table.repartition(3).write.parquet(f"{self.path}/{name}") if name == "pieces" else write(self, table, name)
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")
            return spark.read.schema(table.schema).parquet(f"{self.path}/{name}")

        monkeypatch.setattr(splits.Staged, "written", written)

    return set_


def table(seed, rows=25, end="\n", stray=True):
    """A table as text, with quoted separators, quotes, line breaks and blank lines in cells, short and long lines."""
    rng = random.Random(seed)
    lines = ["a\tb\tc"]
    for i in range(rows):
        cells = [str(i)]
        for _ in range(rng.choice([0, 1, 2, 2, 2, 2, 3])):
            text = "".join(rng.choice(["x", "y z", "\t", '"', "\n", "é", "\n\n", "'"]) for _ in range(rng.randint(0, 6)))
            plain = text.replace("\t", " ").replace("\n", " ")
            cells.append('"' + text.replace('"', '""') + '"' if rng.random() < 0.5 else ((plain.lstrip('"') if stray else plain.replace('"', "")) or "w"))
        lines.append("\t".join(cells))
        if rng.random() < 0.1:
            lines.append("")
    return "\n".join([*lines, *rng.choice([[], [""]])]).replace("\n", end)


def due(text, limit=None):
    """The rows of lines that aren't too long, by the standard library; missing and empty cells are None."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter="\t") if r][1:]
    rows = [[c.replace("\r\n", "\n") for c in r] for r in rows if len(r) <= 3][:limit]
    return [tuple(c or None for c in [*r, *[None] * (3 - len(r))]) for r in rows]


def read(spark, path, **more):
    return [tuple(r) for r in read_delimited(spark, str(path), infer=False, bad_lines="skip", **more).collect()]


@pytest.mark.parametrize("size", SPLITS)
def test_same_rows_at_any_split(spark, tmp_path, small_splits, size):
    small_splits(size)
    for seed in (1, 2):
        path = tmp_path / f"{seed}.tsv"
        path.write_text(table(seed), encoding="utf-8")
        assert sorted(read(spark, path), key=repr) == sorted(due(table(seed)), key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_same_rows_as_one_task(spark, tmp_path, small_splits, seed):
    small_splits(50)
    path = tmp_path / "t.tsv"
    # one task takes a stray quote in a cell for an opening one when it counts fields
    path.write_text(table(seed, stray=False), encoding="utf-8")
    many, one = (sorted(read(spark, path, split=s), key=repr) for s in (True, False))
    assert many == one and len(many) > 15


@pytest.mark.parametrize("size", [23, 1 << 20])
def test_first_rows_are_those_of_the_file(spark, tmp_path, small_splits, size):
    small_splits(size)
    path = tmp_path / "t.tsv"
    path.write_text(table(5, 20), encoding="utf-8")
    for n in (0, 11, 500):
        assert sorted(read(spark, path, limit=n), key=repr) == sorted(due(table(5, 20), n), key=repr)


def test_first_rows_of_several_files(spark, tmp_path, small_splits):
    small_splits(60)
    (tmp_path / "d").mkdir()
    texts = [table(k, 5 + 3 * k) for k in range(10)]
    for k, text in enumerate(texts):
        (tmp_path / "d" / f"{k:02}.tsv").write_text(text, encoding="utf-8")
    rows = [r for text in texts for r in due(text)]
    for n in (3, 1000):
        assert sorted(read(spark, tmp_path / "d", limit=n), key=repr) == sorted(rows[:n], key=repr)
    assert sorted(read(spark, tmp_path / "d"), key=repr) == sorted(rows, key=repr)


def test_carriage_returns_marks_and_compressed_files(spark, tmp_path, small_splits):
    small_splits(40)
    text = table(6, 30, "\r\n")
    (tmp_path / "t.tsv").write_bytes(b"\xef\xbb\xbf" + text.encode())
    assert sorted(read(spark, tmp_path / "t.tsv"), key=repr) == sorted(due(text), key=repr)
    assert read_delimited(spark, str(tmp_path / "t.tsv"), bad_lines="skip").columns == ["a", "b", "c"]
    with gzip.open(tmp_path / "t.tsv.gz", "wt", encoding="utf-8", newline="") as out:
        out.write(table(7))
    assert sorted(read(spark, tmp_path / "t.tsv.gz"), key=repr) == sorted(due(table(7)), key=repr)
    assert sorted(read(spark, tmp_path / "t.tsv.gz", limit=9), key=repr) == sorted(due(table(7), 9), key=repr)


def test_a_long_line_in_the_first_rows_raises(spark, tmp_path, small_splits):
    small_splits(8)
    path = tmp_path / "t.tsv"
    path.write_text('a\tb\n1\t2\n"3\n3"\t4\n"5\n5"\t6\t7\n8\t9\n')
    assert read_delimited(spark, str(path), limit=2).count() == 2
    for limit in (3, None):
        with pytest.raises(ValueError, match="more than 2"):
            read_delimited(spark, str(path), limit=limit)
    assert read_delimited(spark, str(path), bad_lines="skip").count() == 3


def test_header_that_crosses_a_cut_and_files_without_rows(spark, tmp_path, small_splits):
    small_splits(5)
    path = tmp_path / "t.tsv"
    path.write_text('\n\n"a\nlong name"\tb\n1\t2\n')
    df = read_delimited(spark, str(path))
    assert df.columns == ["a\nlong name", "b"] and [tuple(r) for r in df.collect()] == [(1, 2)]
    path.write_text("a\tb\n")
    assert read_delimited(spark, str(path)).count() == 0
    assert read_delimited(spark, str(path), limit=5).columns == ["a", "b"]


def test_an_unclosed_quote_reaches_to_the_end(spark, tmp_path, small_splits):
    path = tmp_path / "t.tsv"
    path.write_text('a\tb\n1\t2\n3\t"open\n4\t5\n6\t7')
    for size in (4, 1 << 20):
        small_splits(size)
        assert sorted(read(spark, path)) == [("1", "2"), ("3", "open\n4\t5\n6\t7")]


def test_a_quoted_cell_longer_than_may_be_held(spark, tmp_path, small_splits, monkeypatch):
    """A block without quotes may lie inside a cell; what is held of it has a bound, beyond which the cell is refused."""
    small_splits(200)
    monkeypatch.setattr(splits, "LONGEST", 50)
    plain = tmp_path / "plain.tsv"
    plain.write_text("a\tb\n" + "".join(f"{k}\tplain {k}\n" for k in range(100)))
    assert len(read(spark, plain)) == 100
    path = tmp_path / "t.tsv"
    path.write_text('a\tb\n1\t"' + "inside\n" * 100 + '"\n2\t3\n')
    with pytest.raises(Exception, match="more than 50 letters"):
        read(spark, path)


def test_tasks_stop_at_the_limit(spark, tmp_path, small_splits):
    small_splits(1 << 20)
    path = tmp_path / "t.tsv"
    with path.open("w") as out:
        out.write("a\tb\n")
        for k in range(300_000):
            out.write(f"{k}\tvalue {k}\n")
    found = read_delimited(spark, str(path), limit=1000)
    assert sorted(r["a"] for r in found.collect()) == list(range(1000))
    staged = splits.Staged(spark, [str(path)], ["a", "b"], "\t", None, 1000, True)
    assert staged.pieces.where("kind = 'record'").count() <= 1001 * staged.blocks.count() < 10_000


@pytest.mark.parametrize(
    ("line", "inside", "found"),
    [
        ("a\tb\tc", False, (2, False)), ("a\tb", True, (0, True)), ('"a\tb"\tc', False, (1, False)), ('x"\ty', False, (1, False)), ('"a', False, (0, True)),
        ('a"\tb', True, (1, False)), ('a""\tb', True, (0, True)), ('""\t""', False, (1, False)), ('"""\t"', False, (0, False)), ('"q"tail\tz', False, (1, False)),
        ('"\t"', True, (1, True)), ("", False, (0, False)), ('"""', False, (0, True)),
    ],
)
def test_scanned(line, inside, found):
    assert splits.scanned(line, inside, "\t") == found
