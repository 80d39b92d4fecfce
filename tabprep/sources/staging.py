"""Files from the web."""

from __future__ import annotations

import tempfile
import urllib.request
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """A folder that all executors reach: the given one, else ``spark.checkpoint.dir``, else, in local mode alone, a temporary one."""
    folder = folder or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="tabprep-")
    if not folder:
        raise ValueError("name a folder that all executors share, or set spark.checkpoint.dir")
    return folder.rstrip("/")


def staged(spark: SparkSession, location: str, folder: str | None = None) -> str:
    """A path that Spark can read: http(s) and ftp locations are fetched once into ``folder``, others returned as they are.

    All executors must reach the folder; it may be one of any file system that
    Spark knows.  Without one, :func:`shared_folder` chooses it.
    """
    parts = urlparse(location)
    if parts.scheme not in ("http", "https", "ftp"):
        return location
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark, folder)}/fetched-{uuid.uuid4().hex}/{parts.path.rsplit('/', 1)[-1]}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        with urllib.request.urlopen(location) as source:
            while block := source.read(1 << 20):
                out.write(block)
    finally:
        out.close()
    return path.toString()
