"""A corpus from quality rules to packed sequences; counted as part of tabprep.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabprep.llm.exact_dedup import exact_dedup
from tabprep.llm.mixing import mix
from tabprep.llm.packing import pack
from tabprep.llm.quality import quality_filter
from tabprep.llm.queries import tokenizer_path
from tabprep.llm.scratch import Scratch
from tabprep.llm.simhash import near_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fail no base rule and are no outliers of their language and source."""
    return quality_filter(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture draws it."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces and their places in sequences."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]

#: Fingerprints, outlier estimates and token ids can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each but the last is written as Parquet and read as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if scratch.made > 1:
            scratch.forget(scratch.made - 2)
    return STAGES[-1][1](spark, docs, sf_dir)
