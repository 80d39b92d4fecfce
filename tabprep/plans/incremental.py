"""A profile that is kept up to date file by file: new files are read, deleted ones forgotten."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted
from ..operators.families import is_numeric, is_text
from ..sources.parquet import without_nan
from .profile import ColumnProfile, TableProfile
from .values import most_frequent

#: Two to this power is the number of cells of a stored sketch.
SKETCH_BITS = 12
FILES = "path string, length long, modified timestamp, states string"


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """The relative standard error of a sketch's number of values."""
    return 1.04 / 2 ** (bits / 2)


def sketches(df: DataFrame, columns: list[str], bits: int = SKETCH_BITS) -> DataFrame:
    """One row with a mergeable sketch of each column's values, to be stored; missing cells don't count."""
    return df.agg(*[F.hll_sketch_agg(quoted(c).cast("string"), bits).alias(c) for c in columns])


def sketched_counts(stored: DataFrame) -> dict[str, int]:
    """About how many values the columns have that rows of :func:`sketches`, of one batch or of many, describe together.

    The error is :func:`sketch_error`, relative, as a standard deviation; exact
    counts are the profile's.
    """
    row = stored.agg(*[F.hll_sketch_estimate(F.hll_union_agg(quoted(c))).alias(c) for c in stored.columns]).first()
    return {c: row[c] or 0 for c in stored.columns}


class ProfileStore:
    """Versions of a folder's profile, as mergeable states of each of its Parquet files, below ``folder``.

    A version lists files with length and modification time, and where their
    states are; its states are those of its files alone, so a file that is gone or
    has changed no longer counts.  Versions are written whole and stay; a refit
    that fails leaves the version before.  Sums of doubles are added file by file.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: Files that the last refit read.
        self.read: list[str] = []

    def version(self) -> int:
        """The number of the latest whole version; 0 without any."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return 0
        whole = [s.getPath() for s in files.listStatus(path) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max([int(p.getName()) for p in whole], default=0)

    def manifest(self) -> DataFrame:
        """Rows (path, length, modified, states) of the latest version's files."""
        n = self.version()
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/versions/{n}") if n else self.spark.createDataFrame([], FILES)

    def refit(self, *locations: str) -> TableProfile:
        """Makes a version of the Parquet files at these locations, reading those that the one before lacks, and profiles it."""
        listed = self.spark.read.format("binaryFile").load(list(locations)).select("path", "length", F.col("modificationTime").alias("modified"))
        before, n = self.manifest(), self.version()
        same = ["path", "length", "modified"]
        kept = before.join(listed, same, "left_semi")
        new = listed.join(before, same, "left_anti")
        # as many paths as Spark lists for a read anyway
        self.read = sorted(r["path"] for r in new.select("path").collect())
        states = f"{self.folder}/states/{uuid.uuid4().hex}"
        if self.read:
            self.write_states(self.read, states)
        kept.unionByName(new.withColumn("states", F.lit(states))).write.parquet(f"{self.folder}/versions/{n + 1}")
        return self.profile()

    def write_states(self, paths: list[str], states: str) -> None:
        table = self.spark.read.parquet(*paths)
        schema, file = table.schema, F.col("_metadata.file_path")
        cells = [(f, F.nanvl(quoted(f.name), F.lit(None).cast(f.dataType)) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else quoted(f.name)) for f in schema]
        rows = table.select(file.alias("file"), *[c.alias(f"c{i}") for i, (_, c) in enumerate(cells)])
        sums, told = [F.count(F.lit(1)).alias("rows")], []
        for i, f in enumerate(schema):
            c, none = F.col(f"c{i}"), {"total": "double", "low": "long", "high": "long", "error": "double", "sketch": "binary"}
            found = {k: F.lit(None).cast(t) for k, t in none.items()}
            if is_numeric(f.dataType):
                found["total"] = F.sum(c.cast("double"))
            if isinstance(f.dataType, T.LongType):
                found |= {"low": F.min(c), "high": F.max(c)}
            if isinstance(f.dataType, T.DoubleType):
                narrow = c.cast("float").cast("double")
                found["error"] = F.max(F.when(narrow == c, F.lit(0.0)).otherwise(F.abs(narrow - c)))
            if is_numeric(f.dataType) or is_text(f.dataType):
                found["sketch"] = F.hll_sketch_agg(c.cast("string"), SKETCH_BITS)
            parts = [F.lit(f.name).alias("column"), F.lit(i).alias("at"), F.lit(f.dataType.json()).alias("type"), F.count(c).alias("non_null")]
            sums.append(F.struct(*parts, *[v.alias(k) for k, v in found.items()]).alias(f"s{i}"))
            told.append(f"s{i}")
        rows.groupBy("file").agg(*sums).select("file", "rows", F.inline(F.array(*told))).write.parquet(f"{states}/columns")
        text = [i for i, f in enumerate(schema) if is_text(f.dataType)]
        if text:
            each = F.array(*[F.when(F.col(f"c{i}").isNotNull(), F.struct(F.lit(schema[i].name).alias("column"), F.col(f"c{i}").alias("value"))) for i in text])
            values = rows.select("file", F.inline(F.filter(each, lambda x: x.isNotNull())))
            values.groupBy("file", "column", "value").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{states}/values")
        else:
            self.spark.createDataFrame([], "file string, column string, value string, n long").write.parquet(f"{states}/values")

    def states(self, kind: str) -> DataFrame | None:
        """The latest version's states of one kind."""
        files = self.manifest()
        folders = sorted(r["states"] for r in files.select("states").distinct().collect())
        if not folders:
            return None
        # states of files that aren't in this version any more are passed over
        listed = files.select(F.col("states").alias("of"), file_name("path").alias("file"))
        stored = self.spark.read.parquet(*[f"{f}/{kind}" for f in folders])
        stored = stored.withColumn("of", F.regexp_extract(F.col("_metadata.file_path"), r"/states/([0-9a-f]+)/", 1)).withColumn("file", file_name("file"))
        return stored.join(listed.withColumn("of", F.regexp_extract("of", r"/states/([0-9a-f]+)$", 1)), ["of", "file"], "left_semi")

    def profile(self) -> TableProfile:
        """The latest version's profile, from its states alone."""
        stored = self.states("columns")
        if stored is None:
            return TableProfile(0, {})
        rows = stored.select("file", "rows").distinct().agg(F.sum("rows")).first()[0]
        sums = {"non_null": F.sum("non_null"), "total": F.sum("total"), "low": F.min("low"), "high": F.max("high"), "error": F.max("error"), "at": F.min("at")}
        merged = stored.groupBy("column").agg(F.collect_set("type").alias("types"), *[v.alias(k) for k, v in sums.items()]).orderBy("at", "column").collect()
        counted = self.states("values").groupBy("column", "value").agg(F.sum("n").alias("n"))
        values = {r["column"]: r for r in counted.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), most_frequent().alias("mode")).collect()}
        columns = {}
        for r in merged:
            if len(r["types"]) > 1:
                raise TypeError(f"column {r['column']!r} has several types: {', '.join(sorted(r['types']))}")
            kind = T._parse_datatype_json_string(r["types"][0])
            own = values.get(r["column"])
            mean = r["total"] / r["non_null"] if is_numeric(kind) and r["non_null"] else None
            distinct = (own["distinct"] if own else 0) if is_text(kind) else None
            columns[r["column"]] = ColumnProfile(r["column"], kind, r["non_null"], distinct, mean, own["mode"] if own else None, r["low"], r["high"], r["error"])
        return TableProfile(rows, columns)

    def sketched_counts(self) -> dict[str, int]:
        """About how many values the number and text columns have, from the stored sketches; see :func:`sketch_error`."""
        stored = self.states("columns")
        if stored is None:
            return {}
        merged = stored.where("sketch IS NOT NULL").groupBy("column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
        return {r["column"]: r["n"] for r in merged.collect()}


def file_name(column: str):
    """A file's path without scheme and with its encoding undone, as listings and scans spell these differently."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(column, r"^[a-z]+:/+", "/"), r"\+", "%2B"))
