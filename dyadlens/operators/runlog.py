"""The collection's log: attempts per slot and day, retries, and a run's status.

Rows without slot or time enter no daily count. Records delivered again count once, by key, with the attempts of the
earliest delivery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(raw: DataFrame) -> DataFrame:
    """(cache_key, model_slot, collected_at, attempts, retry_events): the earliest delivery of each record."""
    pick = F.min(F.struct("collected_at", "attempts", "retry_events")).alias("x")
    return raw.where("cache_key is not null").groupBy("cache_key", "model_slot").agg(pick).select("cache_key", "model_slot", "x.*")


def daily_attempts(raw: DataFrame, cap: int = 175) -> DataFrame:
    """(model_slot, day, n, attempts, capped) per UTC day."""
    df = raw.where("model_slot is not null and collected_at is not null").groupBy("model_slot", F.to_date("collected_at").alias("day"))
    return df.agg(F.count("*").alias("n"), F.sum("attempts").cast("long").alias("attempts")).withColumn("capped", F.col("attempts") >= cap)


def retry_telemetry(raw: DataFrame) -> DataFrame:
    """(model_slot, outcome, http_status, n): retries by what caused them."""
    e = raw.select("model_slot", F.explode("retry_events").alias("e"))
    return e.groupBy("model_slot", "e.outcome", "e.http_status").agg(F.count("*").alias("n"))


def run_status(written: Column, failed: Column, capped: Column) -> Column:
    """FAILURE if nothing was written or half of five and more attempts failed; PARTIAL_SUCCESS, CAPPED_CLEAN, SUCCESS."""
    tried = written + failed
    clean = F.when(capped > 0, "CAPPED_CLEAN").otherwise("SUCCESS")
    systemic = (written == 0) | ((tried >= 5) & (failed / F.greatest(tried, F.lit(1)) >= 0.5))
    return F.when(tried == 0, clean).when(systemic, "FAILURE").when(failed > 0, "PARTIAL_SUCCESS").otherwise(clean)
