"""Delimited text with a header, read by explicit rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted
from .splits import records
from .staging import staged

#: Cells that count as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
#: Cells that count as truth values, and what numbers look like.
TRUE, FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
CORRUPT = "_corrupt_record"


def unique_names(names: list[str]) -> list[str]:
    """Header names, repeated ones numbered: a, a.1, a.2."""
    taken, out = set(names), []
    for name in names:
        new, k = name, 0
        while new in out:
            k += 1
            new = f"{name}.{k}" if f"{name}.{k}" not in taken else new
        out.append(new)
    return out


def as_number(c: Column) -> Column:
    """Text as double; infinities in any spelling."""
    body = F.lower(F.trim(c))
    spelled = F.when(body.rlike(r"^\+?inf"), F.lit(float("inf"))).when(body.rlike(r"^-inf"), F.lit(float("-inf")))
    return spelled.otherwise(body.try_cast("double"))


def inferred(df: DataFrame) -> DataFrame:
    """Types text columns by all their values, in one action: long, double, boolean or string.

    A column without values is double.  Whole numbers are long if they fit and
    none is missing, else double.  Truth values with missing cells stay text, and
    dates do always.
    """
    checks = []
    for i, name in enumerate(df.columns):
        c = quoted(name)
        checks += [
            F.count(c).alias(f"n_{i}"),
            F.bool_and(c.rlike(INTEGER) & F.trim(c).try_cast("long").isNotNull()).alias(f"long_{i}"),
            F.bool_and(c.rlike(NUMBER)).alias(f"double_{i}"),
            F.bool_and(c.isin(*TRUE, *FALSE)).alias(f"boolean_{i}"),
        ]
    if not checks:
        return df
    found = df.agg(F.count(F.lit(1)).alias("rows"), *checks).first()
    out = []
    for i, name in enumerate(df.columns):
        c, whole = quoted(name), found[f"n_{i}"] == found["rows"]
        if found[f"n_{i}"] == 0:
            c = F.lit(None).cast("double")
        elif found[f"long_{i}"] and whole:
            c = F.trim(c).try_cast("long")
        elif found[f"double_{i}"]:
            c = as_number(c)
        elif found[f"boolean_{i}"] and whole:
            c = c.isin(*TRUE)
        out.append(c.alias(name))
    return df.select(*out)


def csv_options(sep: str, encoding: str = "UTF-8") -> dict:
    return {"sep": sep, "quote": '"', "escape": '"', "multiLine": True, "encoding": encoding, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def header(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> list[str]:
    """The column names in a file's first line."""
    head = spark.read.options(header=False, **csv_options(sep, encoding)).csv(path).first()
    return unique_names([f"_c{i}" if x is None else x for i, x in enumerate(head or [])])


def one_task(spark: SparkSession, path: str, names: list[str], options: dict, limit: int | None, bad_lines: str) -> DataFrame:
    """The cells f0, f1 and so on of all lines that count, a file read by one task."""
    fields = [T.StructField(f"f{i}", T.StringType()) for i in range(len(names))]
    kind = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.options(header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options).schema(kind).csv(path)
    bare = F.regexp_replace(CORRUPT, '"(?:[^"]|"")*"', "")
    separators = F.length(bare) - F.length(F.replace(bare, F.lit(options["sep"]), F.lit("")))
    long_line = F.coalesce(F.col(CORRUPT).isNotNull() & (separators >= len(names)), F.lit(False))
    if bad_lines == "error":
        looked_at = rows if limit is None else rows.limit(limit)
        bad = looked_at.select("*", long_line.alias("bad")).where("bad").head(1)
        if bad:
            raise too_long(path, names, bad[0][CORRUPT])
    # Spark refuses to read the record alone, so a cell is always looked at
    kept = rows.where(~long_line & (F.length(F.coalesce(F.col("f0"), F.lit(""))) >= 0))
    return kept if limit is None else kept.limit(limit)


def many_tasks(spark: SparkSession, path: str, names: list[str], sep: str, limit: int | None, bad_lines: str, folder: str | None) -> DataFrame:
    """As :func:`one_task`, a file read by many tasks."""
    found = records(spark, path, names, sep, limit, bad_lines, folder)
    if bad_lines == "error":
        refuse_long_lines(found, path, names)
    return found.select("cells.*")


def refuse_long_lines(found: DataFrame, path: str, names: list[str]) -> None:
    if bad := found.where("kind = 'bad'").head(1):
        raise too_long(path, names, bad[0]["record"])


def too_long(path: str, names: list[str], line: str) -> ValueError:
    return ValueError(f"a line of {path} has more than {len(names)} fields: {line[:200]!r}")


def read_delimited(
    spark: SparkSession,
    location: str,
    sep: str = "\t",
    limit: int | None = None,
    bad_lines: str = "error",
    encoding: str = "UTF-8",
    infer: bool = True,
    folder: str | None = None,
    split: bool = True,
) -> DataFrame:
    """A table from delimited text with a header line; compressed files are read by their suffix.

    Short lines are padded.  Lines with too many fields are left out with
    ``bad_lines="skip"``, before the first ``limit`` of rows is taken; else they
    raise an error, those beyond ``limit`` excepted, as nothing is read there.
    Quotes may hold separators, line breaks and doubled quotes.  Files from the
    web are fetched into ``folder``, see :func:`staged`.  Cells in NULL_TOKENS are
    missing.  Names may repeat; see :func:`unique_names`.

    With ``split`` many tasks read an uncompressed file, whatever its quotes hold,
    and write its cells once as Parquet into ``folder``, from where types are
    inferred and columns are read; see :mod:`.splits`.  Lines end with a line feed,
    with or without a carriage return.  The first ``limit`` of rows is in the order
    of file names and places in the files, however the files are split; tasks stop
    there.  Without ``split``, or if the encoding isn't UTF-8, one task reads a
    file, several times, and ``limit`` takes any rows of several files.
    """
    if bad_lines not in ("error", "skip"):
        raise ValueError(f"bad_lines is 'error' or 'skip', not {bad_lines!r}")
    path = staged(spark, location, folder)
    names, options = header(spark, path, sep, encoding), csv_options(sep, encoding)
    whole = split and encoding.upper().replace("_", "-") in ("UTF-8", "UTF8")
    kept = many_tasks(spark, path, names, sep, limit, bad_lines, folder) if whole else one_task(spark, path, names, options, limit, bad_lines)
    cells = [F.when(~F.col(f"f{i}").isin(*NULL_TOKENS), F.col(f"f{i}")).alias(name) for i, name in enumerate(names)]
    table = kept.select(*cells)
    return inferred(table) if infer else table
