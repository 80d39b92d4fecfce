"""Sessions of events as they arrive: repeated events left out, late ones counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.columns import quoted


@dataclass(frozen=True)
class Sessions:
    """How events make sessions.

    Events of one ``key`` belong to one session as long as ``gap`` at most lies
    between them.  Of events with the same values in ``same`` the first to arrive
    counts, if the others come within ``delay`` of it in ``time``.  Events that are
    older than the newest event before their batch by more than ``delay`` are late
    and left out.  Missing times are left out as well; missing keys make sessions
    of their own.
    """

    key: str
    time: str
    value: str
    same: tuple[str, ...]
    gap: str = "30 minutes"
    delay: str = "1 hour"

    def of(self, events: DataFrame) -> DataFrame:
        """Rows (key, start, end, n, total) of the sessions of a table, or of a stream's closed ones."""
        timed = events.where(quoted(self.time).isNotNull()).withColumn(self.time, quoted(self.time).cast("timestamp"))
        if events.isStreaming:
            once = timed.withWatermark(self.time, self.delay).dropDuplicatesWithinWatermark(list(self.same))
        else:
            once = timed.dropDuplicates(list(self.same))
        session = F.session_window(quoted(self.time), self.gap).alias("session")
        sums = [F.count(F.lit(1)).alias("n"), F.sum(quoted(self.value)).alias("total")]
        found = once.groupBy(quoted(self.key), session).agg(*sums)
        return found.select(quoted(self.key), F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n", "total")


def session_files(spark: SparkSession, sessions: Sessions, schema: StructType, source: str, target: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Adds the sessions that close with the Parquet files below ``source`` that ``checkpoint`` hasn't seen to ``target``, and stops.

    ``files`` at most make a batch.  A session closes once an event is newer than
    its end by the delay; what is open stays in the checkpoint's state, which is
    held by key, so memory follows the open sessions and the events within a delay.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return sessions.of(arriving).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """How many events a stopped query has left out as late, in its progress reports that are held."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"][-1:])
