"""Additive roll-ups over Structured Streaming: event-time windows, sessions, and de-duplicated counts.

Beyond the batch operators: sums, counts and maxima are mergeable, so the same
expressions run over a stream with a watermark that bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream, in bounded micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_rollup(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours", by: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Count, sum and maximum per key and window; rows later than the watermark are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total", "largest")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", by: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions per key, closed by a gap."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each event once; the watermark bounds the keys that are remembered."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into a Parquet folder, exactly once, and stop."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
