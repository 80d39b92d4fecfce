"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .ranks import KEY_BITS, digest_key, running
from .scratch import Scratch


def stratum(source: str) -> dict[str, Column]:
    """Two columns without nulls for a source, of which a null is one stratum."""
    col = F.col(quoted(source))
    return {"no_source": col.isNull(), "source_name": F.coalesce(col.cast("string"), F.lit(""))}


def interleave(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot, position, source_rank.

    Rows are ranked within their source by a seeded hash.  The fractional rank
    (rank + phase) / (rows of the source), with a seeded phase from 0 to 1 for
    each source, is spread alike for every source, so in its order each stretch
    has the mixture of the whole, many small sources included; that order is cut
    into ``shards`` parts whose row counts are at most one apart.

    Size is the text's UTF-8 bytes plus 1; a null text counts as empty, a very
    long one as a whole.  Null sources are a stratum of their own, null ids rows
    like others, of any type.  Equal keys are told apart by id, checksum and
    size; repeated rows are placed one by one.  An empty table gives no rows.
    The result depends on the rows' values and ``seed`` alone.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    slim = docs.select(
        F.col(quoted(doc_id)).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        *[c.alias(n) for n, c in stratum(source).items()],
    )
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    slim = scratch.keep(slim.withColumn("key", digest_key(seed, ident, F.col("text_crc32"), F.col("size"))))
    rows = slim.count()
    strata, whole = ["no_source", "source_name"], float(2**KEY_BITS)
    ranked = running(slim, strata, "key", ["doc_id", "text_crc32", "size"], rows=rows)
    phase = digest_key(seed, "phase", F.col("no_source").cast("int"), F.col("source_name")) / F.lit(whole)
    fraction = (F.col("rank") + phase) / F.col("group_rows") * F.lit(whole)
    ranked = ranked.withColumns({"key": F.least(F.floor(fraction), F.lit(2**KEY_BITS - 1)), "source_rank": F.col("rank")})
    ranked = scratch.keep(ranked.drop("rank", "group_rows"))
    placed = running(ranked, [], "key", [*strata, "source_rank"], rows=rows).withColumnRenamed("rank", "position")
    shard = F.expr(f"position * {shards} div {max(1, rows)}")
    first = F.expr(f"({rows} * shard + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col("position") - first)
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot", "position", "source_rank")
