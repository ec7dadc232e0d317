"""Event-time tumbling-window metrics in Structured Streaming (SS3).

The reference counts late rows forever (no watermark, state never freed).
``watermark_delay=None`` keeps that behaviour (update mode); with a delay, state
is dropped once the watermark passes and later rows are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.operators.parse import parse_events
from latencylab.operators.rules import DEFAULT_RULES, apply_fraud_rules
from latencylab.operators.running import metric_keys


def window_metrics_stream(values: DataFrame, window: str = "30 seconds", watermark_delay: str | None = None,
                          profile=DEFAULT_RULES) -> DataFrame:
    ev = metric_keys(apply_fraud_rules(parse_events(values, flatten=True), profile))
    ev = ev.withColumn("event_time", F.timestamp_millis(F.col("sent_at_ms")))
    if watermark_delay is not None:
        ev = ev.withWatermark("event_time", watermark_delay)
    return ev.groupBy(
        F.window("event_time", window).alias("w"), "run_id", "metric_scenario", "metric_channel",
        "metric_transaction_type",
    ).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.coalesce(F.sum("TransactionAmount"), F.lit(0.0)).alias("total_amount"),
        F.sum(F.when(F.col("is_fraud"), 1).otherwise(0)).cast("long").alias("fraud_count"),
    ).select(
        F.unix_millis(F.col("w.start")).alias("bucket_start_ms"), "run_id", "metric_scenario", "metric_channel",
        "metric_transaction_type", "transaction_count", "total_amount", "fraud_count",
        (F.col("total_amount") / F.col("transaction_count")).alias("avg_amount"),
    )


def dedupe_events(values: DataFrame, watermark_delay: str = "10 minutes") -> DataFrame:
    """Optional: drop re-delivered events (same run and event id) within the
    watermark. The reference measures duplicates and keeps them; this is opt-in."""
    ev = parse_events(values, flatten=True).withColumn("event_time", F.timestamp_millis(F.col("sent_at_ms")))
    return ev.withWatermark("event_time", watermark_delay).dropDuplicatesWithinWatermark(["run_id", "event_id"])
