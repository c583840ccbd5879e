"""Structured Streaming forms: incremental scoring, idempotent ingestion and the daily cap.

Late rows: the watermark is on collected_at; rows later than it are dropped by the windowed count only, scoring is
stateless and keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import score
from ..schemas import RAW


def raw_stream(spark: SparkSession, folder: str, kind: str = "json", files_a_batch: int = 1000) -> DataFrame:
    """The append-only folder of immutable records as a stream; the checkpoint remembers which files were read."""
    r = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_a_batch)
    return r.option("multiLine", True).option("pathGlobFilter", "*.json").json(folder) if kind == "json" else r.format(kind).load(folder)


def once_by_key(stream: DataFrame, within: str = "30 days") -> DataFrame:
    """Each key once within the watermark's span; state is bounded by it."""
    return stream.withWatermark("collected_at", within).dropDuplicatesWithinWatermark(["cache_key"])


def daily_counts(stream: DataFrame, within: str = "1 day", cap: int = 175) -> DataFrame:
    """Attempts per slot and UTC day, and whether they have reached the day's cap."""
    w = stream.withWatermark("collected_at", within).groupBy(F.window("collected_at", "1 day"), "model_slot")
    return w.agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts")).select("model_slot", F.col("window.start").cast("date").alias("day"), "n", "attempts", (F.col("attempts") >= cap).alias("capped"))


def score_available(stream: DataFrame, into: str, checkpoint: str) -> StreamingQuery:
    """Score what is there and stop cleanly; started again, it goes on where it stopped."""
    return score(stream).writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_available(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Daily counts of what is there, into a table in memory (tests and dashboards)."""
    out = daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName(name)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
