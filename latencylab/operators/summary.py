"""Per-run summaries for all runs at once (AG9, AG10, AG12, PRJ25-PRJ27, JN6, JN14).

The reference answers one run per call with ``cross join`` to one-row CTEs; here
every one-row-per-run bound is an equi-join on ``run_id``, so one plan serves all
runs. Latency comes from time buckets when the run has any, else from raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.functions.columns import parse_run_id
from latencylab.functions.stats import with_ci95
from latencylab.operators.runs import SelectedTables
from latencylab.operators.scan import value_statistics

LATENCY_COLUMNS = [
    "measured_messages", "latency_sample_count", "avg_latency_ms", "median_latency_ms",
    "p95_latency_ms", "stddev_latency_ms", "max_latency_ms",
]


# Interpolated percentiles of raw latencies.
QUANTILES = {"median_latency_ms": ("cont", 0.5), "p95_latency_ms": ("cont", 0.95)}
LATENCY_MOMENTS = {"avg_latency_ms": "avg", "stddev_latency_ms": "stddev", "max_latency_ms": "max"}


def _ids(df: DataFrame) -> DataFrame:
    return df.select("run_id").distinct()


def distinct_per_run(events: DataFrame, *aggs) -> DataFrame:
    """Messages, distinct ids and id range per run (and any decomposable ``(name, fn, column)``): rows are
    combined per (run, id) first, so the distinct count is a plain count."""
    per_id = events.groupBy("run_id", "event_id").agg(F.count(F.lit(1)).alias("_n"), *[fn(c).alias(f"_{n}") for n, fn, c in aggs])
    return per_id.groupBy("run_id").agg(
        F.sum("_n").alias("messages"), F.count("event_id").alias("distinct_events"),
        F.min("event_id").alias("min_event_id"), F.max("event_id").alias("max_event_id"),
        *[fn(f"_{n}").alias(n) for n, fn, _ in aggs],
    )


def all_events(t) -> DataFrame:
    """Event counts per run: the summary row, else the raw rows (bucket-only runs
    have no summary)."""
    s = t.processed_run_summaries.select(
        "run_id", F.col("messages").cast("long").alias("messages"),
        F.col("distinct_events").cast("long").alias("distinct_events"), "min_event_id", "max_event_id",
        "first_sent_at_ms", "first_collected_at_ms", "last_collected_at_ms",
    )
    raw = distinct_per_run(
        t.processed_events.join(_ids(t.processed_run_summaries), "run_id", "left_anti"),
        ("first_sent_at_ms", F.min, "sent_at_ms"), ("first_collected_at_ms", F.min, "collected_at_ms"),
        ("last_collected_at_ms", F.max, "collected_at_ms"),
    )
    return s.unionByName(raw)


def bucket_latency(buckets: DataFrame, warmup_ms: int = 0) -> DataFrame:
    """Latency of a run from its time buckets after the warm-up offset:
    message-weighted mean, mean of bucket medians and p95s, sample stddev of bucket
    means (n = number of buckets with a mean), max."""
    b = buckets.where(F.col("bucket_offset_ms") >= F.lit(warmup_ms))
    return b.groupBy("run_id").agg(
        F.sum("messages").cast("long").alias("measured_messages"),
        F.count("avg_latency_ms").alias("latency_sample_count"),
        (F.sum(F.col("avg_latency_ms") * F.col("messages")) / F.nullif(F.sum("messages"), F.lit(0))).alias("avg_latency_ms"),
        F.avg("median_latency_ms").alias("median_latency_ms"),
        F.avg("p95_latency_ms").alias("p95_latency_ms"),
        F.stddev_samp("avg_latency_ms").alias("stddev_latency_ms"),
        F.max("max_latency_ms").alias("max_latency_ms"),
    )


def raw_latency(events: DataFrame, bounds: DataFrame, warmup_ms: int = 0) -> DataFrame:
    """Latency of a run from raw rows arriving at or after start + warm-up."""
    start = F.coalesce(F.col("first_sent_at_ms"), F.col("first_collected_at_ms"))
    rows = events.where(F.col("latency_ms").isNotNull()).join(
        bounds.select("run_id", start.alias("_start")), "run_id"
    ).where(F.col("collected_at_ms") >= F.col("_start") + F.lit(warmup_ms))
    return value_statistics(rows, ["run_id"], "latency_ms", QUANTILES, {"measured_messages": "count", "latency_sample_count": "count", **LATENCY_MOMENTS})


def run_summary(t, warmup_seconds: float = 0.0) -> DataFrame:
    """Summary of every run that has a summary or raw rows: counts, missing ids,
    duplicates, arrival bounds, latency statistics and the 95 % CI of the mean."""
    warmup_ms = int(warmup_seconds * 1000)
    a = all_events(t)
    has_b = _ids(t.processed_event_buckets)
    compact = (
        a.select("run_id").join(has_b, "run_id", "left_semi")
        .join(bucket_latency(t.processed_event_buckets, warmup_ms), "run_id", "left")
        .withColumn("latency_sample_count", F.coalesce("latency_sample_count", F.lit(0).cast("long")))
    )
    raw = (
        a.select("run_id").join(has_b, "run_id", "left_anti")
        .join(raw_latency(t.processed_events, a, warmup_ms), "run_id", "left")
        .withColumn("measured_messages", F.coalesce("measured_messages", F.lit(0).cast("long")))
        .withColumn("latency_sample_count", F.coalesce("latency_sample_count", F.lit(0).cast("long")))
    )
    lat = compact.select("run_id", *LATENCY_COLUMNS).unionByName(raw.select("run_id", *LATENCY_COLUMNS))
    parts = parse_run_id("run_id")
    out = a.join(lat, "run_id").select(
        "run_id",
        parts["framework"].alias("framework"), parts["scenario"].alias("scenario"),
        parts["iteration"].alias("iteration"),
        "messages", "distinct_events", "min_event_id", "max_event_id",
        F.greatest((F.col("max_event_id") - F.col("min_event_id") + 1) - F.col("distinct_events"), F.lit(0))
        .alias("missing_event_ids"),
        F.greatest(F.col("messages") - F.col("distinct_events"), F.lit(0)).alias("duplicate_messages"),
        "first_sent_at_ms", "first_collected_at_ms", "last_collected_at_ms",
        *LATENCY_COLUMNS,
    )
    return with_ci95(out, "avg_latency_ms", "stddev_latency_ms", "latency_sample_count", "avg_latency")


def run_summary_bucket(t, warmup_seconds: float = 0.0) -> DataFrame:
    """The bucket path alone, for every run with buckets (bucket-only runs included)."""
    out = bucket_latency(t.processed_event_buckets, int(warmup_seconds * 1000)).withColumn(
        "latency_sample_count", F.col("latency_sample_count").cast("long")
    )
    return with_ci95(out, "avg_latency_ms", "stddev_latency_ms", "latency_sample_count", "avg_latency")


SUMMARY_IDS = ("run_id", "framework", "scenario", "iteration")
DELTAS = ("avg_latency_ms", "p95_latency_ms", "messages")


def compare_runs(summary: DataFrame, pairs: DataFrame, metrics=None) -> DataFrame:
    """Side-by-side summaries for (left_run_id, right_run_id) pairs plus deltas
    (right - left): every field of both summaries, the confidence interval included. Equi-joins on
    the ids; no cross join. The warm-up is that of ``summary``."""
    metrics = list(metrics or [c for c in summary.columns if c not in SUMMARY_IDS])
    s = summary.select("run_id", *metrics)
    left = s.select(F.col("run_id").alias("left_run_id"), *[F.col(m).alias(f"left_{m}") for m in metrics])
    right = s.select(F.col("run_id").alias("right_run_id"), *[F.col(m).alias(f"right_{m}") for m in metrics])
    out = pairs.join(left, "left_run_id").join(right, "right_run_id")
    return out.withColumns({f"delta_{m}": F.col(f"right_{m}") - F.col(f"left_{m}") for m in DELTAS if m in metrics})


def compare_two_runs(t, left_run_id: str, right_run_id: str, warmup_seconds: float = 0.0) -> DataFrame:
    """The comparison of two given runs: one row, or none if either is unknown."""
    s = run_summary(SelectedTables(t, (left_run_id, right_run_id)), warmup_seconds)
    pair = t.spark.createDataFrame([(left_run_id, right_run_id)], "left_run_id string, right_run_id string")
    return compare_runs(s, pair)


def compare_by_scenario(t, warmup_seconds: float = 0.0, left: str = "spark", right: str = "flink") -> DataFrame:
    """All pairs of a left and a right framework's run with the same scenario and iteration. The summary
    is computed once, grouped by (scenario, iteration) and spread over the two sides."""
    s = run_summary(t, warmup_seconds)
    metrics = [c for c in s.columns if c not in SUMMARY_IDS]
    row = F.struct("run_id", *metrics)
    sides = s.groupBy("scenario", "iteration").agg(*[
        F.max(F.when(F.col("framework") == fw, row)).alias(side) for side, fw in (("left", left), ("right", right))
    ]).where(F.col("left").isNotNull() & F.col("right").isNotNull())
    out = sides.select(
        "scenario", "iteration",
        *[F.col(f"{side}.{m}").alias(f"{side}_{m}") for side in ("left", "right") for m in ("run_id", *metrics)],
    )
    return out.withColumns({f"delta_{m}": F.col(f"right_{m}") - F.col(f"left_{m}") for m in DELTAS})


def loss_duplication(events: DataFrame) -> DataFrame:
    """Per run: messages, distinct ids, id range, missing ids and duplicates.
    Duplicates are measured, not removed."""
    agg = distinct_per_run(events)
    return agg.withColumn(
        "missing_event_ids",
        F.greatest((F.col("max_event_id") - F.col("min_event_id") + 1) - F.col("distinct_events"), F.lit(0)),
    ).withColumn("duplicate_messages", F.greatest(F.col("messages") - F.col("distinct_events"), F.lit(0)))


def ci95_runs(events: DataFrame) -> DataFrame:
    """Mean latency per run with its Student-t 95 % interval (null when n < 2)."""
    agg = events.groupBy("run_id").agg(
        F.count("latency_ms").alias("latency_sample_count"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.stddev_samp("latency_ms").alias("stddev_latency_ms"),
    )
    return with_ci95(agg, "avg_latency_ms", "stddev_latency_ms", "latency_sample_count", "avg_latency")


def fault_timeline(t) -> DataFrame:
    """Fault log rows with seconds elapsed since the run start (first sent, else
    first collected, of the run's summary); null for runs without one."""
    start = all_events(t).select(
        "run_id", F.coalesce("first_sent_at_ms", "first_collected_at_ms").alias("_start")
    )
    f = t.fault_events.join(start, "run_id", "left")
    return f.select(
        "run_id", "service", "container", "action", "phase", "timestamp_ms",
        ((F.col("timestamp_ms") - F.col("_start")) / F.lit(1000.0)).alias("elapsed_seconds"),
    ).orderBy("run_id", "timestamp_ms", "phase", "container")
