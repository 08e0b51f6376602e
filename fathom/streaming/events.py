"""Streaming forms: de-duplication within a watermark, routing of deliveries, windowed counts, job batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deduplicate(deliveries: DataFrame, hours: int = 24, time: str = "ts", key: str = "delivery_id") -> DataFrame:
    """First delivery of an id within the hours; state leaves with the watermark. time must be a timestamp."""
    return deliveries.withWatermark(time, f"{hours} hours").dropDuplicatesWithinWatermark([key])


def route(deliveries: DataFrame, repositories: DataFrame) -> DataFrame:
    """deliveries (event, action, deleted, repo_id) to actions; unregistered repositories are dropped by a stream-static join."""
    action = (
        F.when((F.col("event") == "push") & ~F.coalesce("deleted", F.lit(False)), "scan")
        .when((F.col("event") == "pull_request") & F.col("action").isin("opened", "synchronize", "reopened"), "scan_changes")
        .when(F.col("event").isin("installation", "installation_repositories"), "sync")
    )
    return deliveries.withColumn("job", action).filter("job is not null").join(repositories.select("repo_id"), "repo_id", "left_semi")


def windowed_counts(events: DataFrame, keys: list[str], length: str, slide: str | None = None, lateness: str = "1 hour", time: str = "ts") -> DataFrame:
    """Tumbling or sliding counts per key with a bound on lateness."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, lateness).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("window_start"), "n")


def session_counts(events: DataFrame, keys: list[str], gap: str, lateness: str = "1 hour", time: str = "ts") -> DataFrame:
    w = F.session_window(time, gap)
    return events.withWatermark(time, lateness).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("window_start"), "n")


def installation_state(events: DataFrame, order: Column) -> DataFrame:
    """The last event of each installation decides: active, suspended or deleted. Redelivery changes nothing."""
    last = events.groupBy("installation_id").agg(F.max_by("action", order).alias("a"))
    return last.select("installation_id", F.when(F.col("a") == "suspend", "suspended").when(F.col("a") == "deleted", "deleted").otherwise("active").alias("state"))


def run_jobs(jobs: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Feeds each micro-batch to handle, which must write idempotently by its batch number."""
    return jobs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
