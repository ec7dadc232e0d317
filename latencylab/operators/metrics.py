"""Collector live metrics rebuilt as aggregates (AG23, AG24, PRJ12): the latency
histogram with its message counter, and mean latency from histogram sum/count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.functions.columns import bucket_floor, rescale_metric_latency

# The metrics client library's default histogram bounds (seconds
# scale, although the collector observes milliseconds), ending with +Inf.
DEFAULT_HISTOGRAM_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf"))
LABELS = ["framework", "scenario", "run_id"]


def latency_histogram(events: DataFrame, bounds: Sequence[float] = DEFAULT_HISTOGRAM_BOUNDS) -> DataFrame:
    """Cumulative count of observed (rescaled) latencies ``<= le`` per label set.

    One pass: one ``count_if`` per bound (partial + final aggregate), then an
    unpivot to one row per bound. Rows without latency are not observed.
    """
    obs = events.where(F.col("latency_ms").isNotNull()).withColumn("_x", rescale_metric_latency("latency_ms"))
    cols = [f"le_{i}" for i in range(len(bounds))]
    agg = obs.groupBy(*LABELS).agg(
        *[F.count_if(F.col("_x") <= F.lit(float(b))).alias(c) for c, b in zip(cols, bounds)]
    )
    long = agg.unpivot(LABELS, cols, "bound", "cumulative_count")
    le_of = F.create_map(*[x for c, b in zip(cols, bounds) for x in (F.lit(c), F.lit(float(b)))])
    return long.select(*LABELS, le_of[F.col("bound")].alias("le"), "cumulative_count")


def messages_counter(events: DataFrame) -> DataFrame:
    """Messages counted by the collector per label set (observed latencies)."""
    return events.where(F.col("latency_ms").isNotNull()).groupBy(*LABELS).agg(
        F.count(F.lit(1)).alias("messages_collected_total")
    )


def rate_avg_latency(events: DataFrame, window_seconds: float = 30.0) -> DataFrame:
    """Mean observed latency per label set and arrival window: the histogram's
    sum over its count inside the window."""
    w = int(window_seconds * 1000)
    obs = events.where(F.col("latency_ms").isNotNull() & F.col("collected_at_ms").isNotNull())
    obs = obs.withColumn("_x", rescale_metric_latency("latency_ms")).withColumn(
        "window_start_ms", bucket_floor("collected_at_ms", w)
    )
    return obs.groupBy(*LABELS, "window_start_ms").agg(
        F.sum("_x").alias("latency_sum"),
        F.count(F.lit(1)).alias("latency_count"),
        (F.sum("_x") / F.count(F.lit(1))).alias("avg_latency_ms"),
    )
