"""A fitted cleaning over files as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.cleaning import CleanerModel
from ..sources.parquet import without_nan


def clean_files(spark: SparkSession, model: CleanerModel, schema: StructType, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Cleans all Parquet files below ``source`` that ``checkpoint`` hasn't seen, into ``target``, and stops.

    The model's fills stay those of the table that it was fitted on.
    """
    arriving = without_nan(spark.readStream.schema(schema).parquet(source))
    cleaned = model.transform(arriving)
    return cleaned.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
