"""Collector rollups: run-start alignment, time-bucket and run summaries, and the
latest-wins rule of an upsert (PRJ30, PRJ31, AG4-AG6, ST4, WN7).

The reference keeps per-bucket counters, id sets and latency lists in one process
and upserts them. Here the same numbers are ``groupBy`` aggregates over the raw
collected rows, recomputed from the rows (so a restart never overwrites counts).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.functions.columns import bucket_floor
from latencylab.operators.scan import arg_extreme, null_safe_join, percentiles

DEFAULT_BUCKET_SECONDS = 5.0


def run_labels(events: DataFrame, how: str = "max", prefix: str = "") -> DataFrame:
    """framework / scenario per run without a string aggregate over raw rows.

    ``min``/``max`` of a string needs a sort-based aggregate (string buffers are not
    fixed-width), i.e. a sort of every row. Instead the (run, framework, scenario)
    combinations are counted with a hash aggregate (strings as keys are fine), and only that
    tiny table is reduced per run. The count is used, else the optimizer would drop the step."""
    combos = events.groupBy("run_id", "framework", "scenario").agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    fn = F.max if how == "max" else F.min
    return combos.groupBy("run_id").agg(
        fn("framework").alias(f"{prefix}framework"), fn("scenario").alias(f"{prefix}scenario")
    )


def run_starts(events: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Run start per run, from the first record *seen* (earliest arrival, then id).

    start = sent - round_half_even((event_id - 1) * 1000 / eps) when the run's
    ``eps`` is known (the back-calculated send time of event 1), else the first
    record's sent time, else its arrival time.
    """
    seen = events.where(F.col("collected_at_ms").isNotNull())
    # earliest arrival, then smallest event id (a null id sorts last)
    first = arg_extreme(
        seen, ["run_id"],
        [F.col("collected_at_ms"), F.coalesce(F.col("event_id"), F.lit(2**63 - 1))],
        ["event_id", "sent_at_ms", "collected_at_ms"],
        names=["first_event_id", "first_record_sent_at_ms", "first_collected_at_ms"],
    )
    return aligned(first, metadata)


def aligned(first: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Adds ``eps`` and the run start to the first records of runs."""
    if metadata is not None:
        first = first.join(metadata.select("run_id", "eps"), "run_id", "left")
    else:
        first = first.withColumn("eps", F.lit(None).cast("double"))
    eps = F.nullif(F.col("eps"), F.lit(0.0))
    back = F.bround((F.col("first_event_id") - 1) * F.lit(1000.0) / eps, 0).cast("long")
    start = (
        F.when(F.col("first_record_sent_at_ms").isNull(), F.col("first_collected_at_ms"))
        .when(back.isNull(), F.col("first_record_sent_at_ms"))
        .otherwise(F.col("first_record_sent_at_ms") - back)
    )
    return first.withColumn("run_start_ms", start)


RANKS = {"median_latency_ms": ("disc", 0.5), "p95_latency_ms": ("disc", 0.95)}


def _statistics(rows: DataFrame, keys: Sequence[str], extra=()) -> DataFrame:
    """Messages, distinct ids, id range and latency statistics per key.

    Rows are first combined per (key, event id): the distinct count is then a plain count, and
    every step is a fixed-width hash aggregate. The percentiles are ranks of counted values."""
    per_id = rows.groupBy(*keys, "event_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("latency_ms").alias("_sum"), F.count("latency_ms").alias("_cnt"),
        F.max("latency_ms").alias("_max"), *[fn(c).alias(f"_{n}") for n, fn, c in extra],
    )
    agg = per_id.groupBy(*keys).agg(
        F.sum("_n").alias("messages"), F.count("event_id").alias("distinct_events"),
        F.min("event_id").alias("min_event_id"), F.max("event_id").alias("max_event_id"),
        F.try_divide(F.sum("_sum"), F.sum("_cnt")).alias("avg_latency_ms"), F.max("_max").alias("max_latency_ms"),
        *[fn(f"_{n}").alias(n) for n, fn, _ in extra],
    )
    return null_safe_join(agg, percentiles(rows, keys, "latency_ms", RANKS), keys, "left")


def bucket_rollup(events: DataFrame, starts: DataFrame, bucket_seconds: float = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """One row per (run, arrival bucket): messages, distinct ids, id range, latency
    avg / nearest-rank p50 / p95 / max. Offsets are floored (negatives included)."""
    width = int(bucket_seconds * 1000)
    rows = events.where(F.col("collected_at_ms").isNotNull()).join(
        starts.select("run_id", "run_start_ms"), "run_id"
    )
    rows = rows.withColumn("bucket_offset_ms", bucket_floor(F.col("collected_at_ms") - F.col("run_start_ms"), width))
    agg = _statistics(rows, ["run_id", "bucket_offset_ms"], [("_start", F.min, "run_start_ms")])
    agg = agg.join(run_labels(events.where(F.col("collected_at_ms").isNotNull())), "run_id", "left")
    return agg.select(
        "run_id", "framework", "scenario", "bucket_offset_ms",
        (F.col("_start") + F.col("bucket_offset_ms")).alias("bucket_start_ms"),
        (F.col("_start") + F.col("bucket_offset_ms") + F.lit(width)).alias("bucket_end_ms"),
        "messages", "distinct_events", "min_event_id", "max_event_id",
        "avg_latency_ms", "median_latency_ms", "p95_latency_ms", "max_latency_ms",
    )


def run_rollup(events: DataFrame, starts: DataFrame) -> DataFrame:
    """One summary row per run, the same statistics over the whole run plus the run
    start and the first / last arrival."""
    rows = events.where(F.col("collected_at_ms").isNotNull())
    agg = _statistics(rows, ["run_id"], [
        ("first_collected_at_ms", F.min, "collected_at_ms"), ("last_collected_at_ms", F.max, "collected_at_ms"),
    ])
    out = agg.join(run_labels(rows), "run_id", "left").join(
        starts.select("run_id", F.col("run_start_ms").alias("first_sent_at_ms")), "run_id", "left"
    )
    return out.select(
        "run_id", "framework", "scenario", "messages", "distinct_events", "min_event_id", "max_event_id",
        "first_sent_at_ms", "first_collected_at_ms", "last_collected_at_ms",
        "avg_latency_ms", "median_latency_ms", "p95_latency_ms", "max_latency_ms",
    )


def latest_wins(df: DataFrame, keys: Sequence[str], version_cols: Sequence[str]) -> DataFrame:
    """What ``INSERT ... ON CONFLICT DO UPDATE`` leaves: the newest row per key.

    ``version_cols`` order versions (newest = largest; numbers or timestamps, the first not null). The
    largest first version per key is a hash aggregate; only rows that reach it are compared further.
    Rows equal in all versions are settled by their other columns (the largest), so the result is defined.
    """
    others = [c for c in df.columns if c not in keys]
    order = [F.col(c) for c in version_cols]
    return arg_extreme(df, keys, order, others, largest=True).select(*keys, *others)
