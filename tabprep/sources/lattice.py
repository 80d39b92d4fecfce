"""Types of text columns over many files: each file's own, their join, and the cells that raise it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import quoted
from . import delimited
from .splits import records
from .staging import shared_folder, staged

#: A column's kind in a file.  ``empty`` lies below all, ``text`` above all, ``long`` below ``double``; ``boolean`` and numbers
#: have only ``text`` above both.
KINDS = ("empty", "boolean", "long", "double", "text")


def joined_kind(kinds: set[str], missing: bool) -> str:
    """The least kind above all; with missing cells whole numbers become doubles, and truth values text.

    The kind of a column of no values is that of :func:`~.delimited.inferred`, double.
    """
    kinds = kinds - {"empty"}
    if not kinds:
        return "double"
    if kinds == {"boolean"}:
        return "text" if missing else "boolean"
    if kinds <= {"long", "double"}:
        return "long" if kinds == {"long"} and not missing else "double"
    return "text"


def file_kinds(table: DataFrame, file: str) -> DataFrame:
    """Rows (column, at, file, kind, missing, value): what the cells of each text column are in each file, in one pass.

    ``value`` is the least cell that raises the kind: one that isn't a whole number
    for ``double`` and ``boolean``, one that is neither number nor, if others are,
    a truth value for ``text``.
    """
    columns = [c for c in table.columns if c != file]
    found = []
    for i, name in enumerate(columns):
        c = quoted(name)
        whole = c.rlike(delimited.INTEGER) & F.trim(c).try_cast("long").isNotNull()
        number, truth = c.rlike(delimited.NUMBER), c.isin(*delimited.TRUE, *delimited.FALSE)
        kind = (
            F.when(F.count(c) == 0, "empty").when(F.bool_and(whole), "long").when(F.bool_and(number), "double").when(F.bool_and(truth), "boolean").otherwise("text")
        )
        odd = F.coalesce(F.min(F.when(~number & ~truth, c)), F.min(F.when(~number, c)), F.min(F.when(~whole, c)))
        parts = [F.lit(name).alias("column"), F.lit(i).alias("at"), kind.alias("kind"), (F.count(c) < F.count(F.lit(1))).alias("missing"), odd.alias("value")]
        found.append(F.struct(*parts).alias(f"s{i}"))
    by_file = table.groupBy(quoted(file).alias("file")).agg(*found)
    return by_file.select("file", F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))]))).select("column", "at", "file", "kind", "missing", "value")


def joined_kinds(kinds: DataFrame) -> dict[str, str]:
    """The kind of each column over all files, as if they were one."""
    rows = kinds.groupBy("column", "at").agg(F.collect_set("kind").alias("kinds"), F.bool_or("missing").alias("missing")).orderBy("at").collect()
    return {r["column"]: joined_kind(set(r["kinds"]), r["missing"]) for r in rows}


def conflicts(kinds: DataFrame) -> DataFrame:
    """Rows (column, file, kind, value) of columns whose files with values have several kinds."""
    several = kinds.where("kind <> 'empty'").groupBy("column").agg(F.count_distinct("kind").alias("n")).where("n > 1").select("column")
    return kinds.where("kind <> 'empty'").join(several, "column", "left_semi").select("column", "file", "kind", "value")


def as_kind(c: Column, kind: str) -> Column:
    if kind == "long":
        return F.trim(c).try_cast("long")
    if kind == "double":
        return delimited.as_number(c)
    return c.isin(*delimited.TRUE) if kind == "boolean" else c


def read_delimited_files(spark: SparkSession, location: str, sep: str = "\t", bad_lines: str = "error", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A table from all delimited files below ``location``, typed over all of them, and the :func:`conflicts` between files.

    Cells and lines are read as :func:`~.delimited.read_delimited` does; files have
    the same header.  The text is read once.
    """
    path = staged(spark, location, folder)
    names = delimited.header(spark, path, sep)
    found = records(spark, path, names, sep, None, bad_lines, folder, with_path=True)
    if bad_lines == "error":
        delimited.refuse_long_lines(found, path, names)
    cells = found.select(F.col("path"), *[F.when(~F.col(f"cells.f{i}").isin(*delimited.NULL_TOKENS), F.col(f"cells.f{i}")).alias(f"f{i}") for i in range(len(names))])
    kinds, stored = file_kinds(cells, "path"), f"{shared_folder(spark, folder)}/kinds-{uuid.uuid4().hex}"
    kinds.write.parquet(stored)
    kinds = spark.read.schema(kinds.schema).parquet(stored)
    joined = joined_kinds(kinds)
    # a table without rows has no kinds
    table = cells.select(*[as_kind(F.col(f"f{i}"), joined.get(f"f{i}", "double")).alias(name) for i, name in enumerate(names)])
    at = F.element_at(F.array(*map(F.lit, names)), F.substring("column", 2, 9).cast("int") + 1)
    return table, conflicts(kinds).withColumn("column", at)
