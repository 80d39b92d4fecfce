"""Parquet scans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted
from .staging import staged


def without_nan(df: DataFrame) -> DataFrame:
    """Turns NaN into NULL in float columns, so that one kind of missing value is left; infinities stay."""
    floats = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[F.nanvl(quoted(c), F.lit(None).cast(floats[c])).alias(c) if c in floats else quoted(c) for c in df.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with NaN as NULL."""
    return without_nan(spark.read.parquet(path))


def read_split(spark: SparkSession, split: str, files: Mapping[str, str], base: str = "", folder: str | None = None) -> DataFrame:
    """One of several named Parquet files of a data set, such as ``{"food": "food.parquet"}`` below ``base``."""
    if split not in files:
        raise KeyError(f"no split {split!r}; there are {', '.join(sorted(files))}")
    return read_parquet(spark, staged(spark, base.rstrip("/") + "/" + files[split] if base else files[split], folder))
