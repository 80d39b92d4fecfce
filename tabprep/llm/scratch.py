"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one is set only where that is unset in local mode."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='tabprep-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """A folder of written tables: they cut lineage, outlive lost executors and can be read many times."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and returns it read back."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, *numbers: int) -> None:
        """Deletes the tables written as these, once nothing reads them any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for number in numbers:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number}")
            path.getFileSystem(conf).delete(path, True)
