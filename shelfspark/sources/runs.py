"""Run log."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.filters import conform
from shelfspark.schemas import RUN_LOG, RUN_LOG_DEFAULTS

DEFAULT_MAX_PAGES = 5


def start_run(spark: SparkSession, source: str, keywords: Sequence[str], config: dict, started_at: str) -> DataFrame:
    """One row for a run that begins: new id, keywords and settings, status running."""
    settings = [F.lit(x) for item in config.items() for x in map(str, item)]
    row = spark.range(1).select(
        # Drawn once, so that a recomputed row keeps its id.
        F.lit(str(uuid.uuid4())).alias("session_id"),
        F.lit(source).alias("source"),
        F.array(*[F.lit(k) for k in keywords]).alias("search_keywords"),
        F.lit(int(config.get("max_pages", DEFAULT_MAX_PAGES))).alias("max_pages"),
        F.lit(started_at).cast("timestamp_ntz").alias("started_at"),
        F.create_map(*settings).alias("scraper_config"),
    )
    return conform(row, RUN_LOG, RUN_LOG_DEFAULTS)


def finish_run(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Run log with the updated fields of the matching runs, and the duration of those that completed.

    ``updates`` has at most one row per run; fields that are no run-log columns are ignored.
    """
    fields = [c for c in updates.columns if c in runs.columns and c != "session_id"]
    changes = updates.select("session_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_u_{c}") for c in fields])
    joined = runs.join(changes, "session_id", "left")
    merged = joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)) for c in fields})
    if "completed_at" in fields:
        seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("completed_at")).cast("int")
        done = F.col("_hit") & F.col("started_at").isNotNull() & F.col("completed_at").isNotNull()
        merged = merged.withColumn("duration_seconds", F.when(done, seconds).otherwise(F.col("duration_seconds")))
    return merged.select(*runs.columns)
