"""Latency / throughput series and group aggregates (AG13, AG14, AG16, AG17,
JN7, JN8, PRJ23, PRJ24, ST2).

Two-level aggregation: per run (or per run and re-bucketed offset) first, then
across runs per group. Each level is a partial+final hash aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.functions.columns import bucket_floor
from latencylab.functions.stats import with_ci95
from latencylab.operators.runs import RunFilter, selected_runs
from latencylab.operators.scan import value_statistics
from latencylab.operators.summary import LATENCY_MOMENTS, QUANTILES, _ids, distinct_per_run


def _weighted_avg():
    return (F.sum(F.col("avg_latency_ms") * F.col("messages")) / F.nullif(F.sum("messages"), F.lit(0))).alias(
        "avg_latency_ms"
    )


def _bucket_aggs(width: int, start_col: str = "bucket_start_ms"):
    return [
        F.min(start_col).alias("bucket_start_ms"),
        F.sum("messages").cast("long").alias("messages"),
        (F.sum("messages") * F.lit(1000.0) / F.lit(float(width))).alias("throughput_eps"),
        _weighted_avg(),
        F.avg("median_latency_ms").alias("median_latency_ms"),
        F.avg("p95_latency_ms").alias("p95_latency_ms"),
        F.stddev_samp("avg_latency_ms").alias("stddev_latency_ms"),
        F.max("max_latency_ms").alias("max_latency_ms"),
    ]


def _raw_stats(rows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Statistics of raw rows (with a latency) per key, all from one read of them."""
    out = value_statistics(rows, keys, "latency_ms", QUANTILES, {"messages": "count", **LATENCY_MOMENTS}, {"bucket_start_ms": (F.min, "collected_at_ms")})
    return out.select(
        *keys, "bucket_start_ms", "messages", (F.col("messages") * F.lit(1000.0) / F.lit(float(width))).alias("throughput_eps"),
        "avg_latency_ms", *QUANTILES, "stddev_latency_ms", "max_latency_ms",
    )


def run_bounds(t) -> DataFrame:
    """Series origin per run: summary start (sent, else collected), else the first
    raw sent / collected time."""
    s = t.processed_run_summaries.select(
        "run_id", F.coalesce("first_sent_at_ms", "first_collected_at_ms").alias("first_ts")
    )
    raw = (
        t.processed_events.join(_ids(t.processed_run_summaries), "run_id", "left_anti")
        .groupBy("run_id")
        .agg(F.min(F.coalesce("sent_at_ms", "collected_at_ms")).alias("first_ts"))
    )
    return s.unionByName(raw)


def latency_series_bucket(t, bucket_seconds: float = 5.0, warmup_seconds: float = 0.0, ordered: bool = True) -> DataFrame:
    """Series from stored time buckets re-bucketed to ``bucket_seconds``."""
    width, warm = int(bucket_seconds * 1000), int(warmup_seconds * 1000)
    b = t.processed_event_buckets.where(F.col("bucket_offset_ms") >= F.lit(warm))
    b = b.withColumn("bucket_offset_ms", bucket_floor("bucket_offset_ms", width))
    return _in_order(b.groupBy("run_id", "bucket_offset_ms").agg(*_bucket_aggs(width)), ordered)


def _in_order(series: DataFrame, ordered: bool) -> DataFrame:
    return series.orderBy("run_id", "bucket_offset_ms") if ordered else series


def latency_series_raw(t, bucket_seconds: float = 5.0, warmup_seconds: float = 0.0, ordered: bool = True) -> DataFrame:
    """Series from raw rows of runs without buckets, offset from the run origin."""
    width, warm = int(bucket_seconds * 1000), int(warmup_seconds * 1000)
    e = (
        t.processed_events.where(F.col("latency_ms").isNotNull())
        .join(_ids(t.processed_event_buckets), "run_id", "left_anti")
        .join(run_bounds(t), "run_id")
        .where(F.col("collected_at_ms") >= F.col("first_ts") + F.lit(warm))
        .withColumn("bucket_offset_ms", bucket_floor(F.col("collected_at_ms") - F.col("first_ts"), width))
    )
    return _in_order(_raw_stats(e, ["run_id", "bucket_offset_ms"], width), ordered)


def latency_series(t, bucket_seconds: float = 5.0, warmup_seconds: float = 0.0) -> DataFrame:
    """Both paths: a run with buckets is served from them, otherwise from raw rows; one sort after the union."""
    both = latency_series_bucket(t, bucket_seconds, warmup_seconds, ordered=False).unionByName(
        latency_series_raw(t, bucket_seconds, warmup_seconds, ordered=False)
    )
    return _in_order(both, True)


def per_run_stats(t, sel: DataFrame, warmup_seconds: float = 0.0) -> DataFrame:
    """Per selected run: counts and latency statistics. Summary runs take latency
    from buckets at or after the warm-up offset (a left join, so the run stays even
    when no bucket qualifies); runs without a summary from their raw rows, with
    the warm-up as an aggregate filter."""
    warm = int(warmup_seconds * 1000)
    keep = [c for c in sel.columns if c not in ("first_ts",)]
    b = t.processed_event_buckets.where(F.col("bucket_offset_ms") >= F.lit(warm)).select(
        "run_id", "messages", "avg_latency_ms", "median_latency_ms", "p95_latency_ms", "max_latency_ms"
    ).withColumnRenamed("messages", "b_messages")
    s = t.processed_run_summaries.select(
        "run_id", F.col("messages").alias("s_messages"), F.col("distinct_events").alias("s_distinct"),
        F.col("min_event_id").alias("s_min"), F.col("max_event_id").alias("s_max"),
    )
    summary_runs = (
        s.join(sel.select(*keep), "run_id")
        .join(b, "run_id", "left")
        .groupBy(*keep)
        .agg(
            F.max("s_messages").cast("long").alias("messages"),
            F.max("s_distinct").cast("long").alias("distinct_events"),
            F.max("s_min").alias("min_event_id"), F.max("s_max").alias("max_event_id"),
            (F.sum(F.col("avg_latency_ms") * F.col("b_messages")) / F.nullif(F.sum("b_messages"), F.lit(0)))
            .alias("avg_latency_ms"),
            F.avg("median_latency_ms").alias("median_latency_ms"),
            F.avg("p95_latency_ms").alias("p95_latency_ms"),
            F.stddev_samp("avg_latency_ms").alias("stddev_latency_ms"),
            F.max("max_latency_ms").alias("max_latency_ms"),
        )
    )
    e = (
        t.processed_events.select("run_id", "event_id", "collected_at_ms", "latency_ms")
        .join(_ids(t.processed_run_summaries), "run_id", "left_anti")
        .join(sel.select(*keep, "first_ts"), "run_id")
        .withColumn(
            "_lat", F.when(F.col("collected_at_ms") >= F.col("first_ts") + F.lit(warm), F.col("latency_ms"))
        )
    )
    latency = value_statistics(e, ["run_id"], "_lat", QUANTILES, LATENCY_MOMENTS)
    raw_runs = sel.select(*keep).join(distinct_per_run(e), "run_id").join(latency, "run_id", "left")
    return summary_runs.unionByName(raw_runs.select(*summary_runs.columns))


def _across_runs() -> list:
    missing = F.greatest((F.col("max_event_id") - F.col("min_event_id") + 1) - F.col("distinct_events"), F.lit(0))
    means = [F.avg(f"{c}_latency_ms").alias(f"avg_of_run_{c}_latency_ms") for c in ("avg", "median", "p95", "stddev")]
    return [
        F.count(F.lit(1)).alias("run_count"),
        F.sum("messages").cast("long").alias("total_messages"),
        F.sum(missing).cast("long").alias("total_missing_event_ids"),
        *means,
        F.stddev_samp("avg_latency_ms").alias("stddev_of_run_avg_latency_ms"),
        F.max("max_latency_ms").alias("max_latency_ms"),
    ]


def aggregate_runs(t, filt: RunFilter | None = None, warmup_seconds: float = 0.0,
                   group_by: Sequence[str] = ()) -> DataFrame:
    """Across-run aggregate of per-run statistics with the 95 % CI of the mean of
    run means (n = run count). ``group_by`` dims give one row per group; without
    them one row for the filtered selection (an empty selection gives run_count 0)."""
    sel = selected_runs(t, filt).select("run_id", "first_ts", *group_by)
    per_run = per_run_stats(t, sel, warmup_seconds)
    aggs = _across_runs()
    out = per_run.groupBy(*group_by).agg(*aggs) if group_by else per_run.agg(*aggs)
    return with_ci95(out, "avg_of_run_avg_latency_ms", "stddev_of_run_avg_latency_ms", "run_count",
                     "avg_of_run_avg_latency")


def aggregate_latency_series(t, filt: RunFilter | None = None, bucket_seconds: float = 5.0,
                             warmup_seconds: float = 0.0, group_by: Sequence[str] = ()) -> DataFrame:
    """Per offset across the selected runs: per-run-bucket statistics first (from
    buckets, or raw rows for runs without buckets), then averaged across runs."""
    width, warm = int(bucket_seconds * 1000), int(warmup_seconds * 1000)
    sel = selected_runs(t, filt).select("run_id", "first_ts", *group_by)
    keys = ["run_id", *group_by]
    b = (
        t.processed_event_buckets.where(F.col("bucket_offset_ms") >= F.lit(warm))
        .select("run_id", "bucket_offset_ms", "messages", "avg_latency_ms", "median_latency_ms", "p95_latency_ms",
                "max_latency_ms")
        .join(sel.drop("first_ts"), "run_id")
        .withColumn("bucket_offset_ms", bucket_floor("bucket_offset_ms", width))
        .groupBy(*keys, "bucket_offset_ms")
        .agg(*_bucket_aggs(width)[1:])
    )
    e = (
        t.processed_events.where(F.col("latency_ms").isNotNull())
        .select("run_id", "collected_at_ms", "latency_ms")
        .join(_ids(t.processed_event_buckets), "run_id", "left_anti")
        .join(sel, "run_id")
        .where(F.col("collected_at_ms") >= F.col("first_ts") + F.lit(warm))
        .withColumn("bucket_offset_ms", bucket_floor(F.col("collected_at_ms") - F.col("first_ts"), width))
    )
    per_run_bucket = b.unionByName(_raw_stats(e, [*keys, "bucket_offset_ms"], width).drop("bucket_start_ms"))
    return (
        per_run_bucket.groupBy(*group_by, "bucket_offset_ms")
        .agg(
            F.count(F.lit(1)).alias("run_count"),
            F.sum("messages").cast("long").alias("messages"),
            F.avg("throughput_eps").alias("throughput_eps"),
            F.avg("avg_latency_ms").alias("avg_latency_ms"),
            F.avg("median_latency_ms").alias("median_latency_ms"),
            F.avg("p95_latency_ms").alias("p95_latency_ms"),
            F.avg("stddev_latency_ms").alias("stddev_latency_ms"),
            F.stddev_samp("avg_latency_ms").alias("stddev_of_run_avg_latency_ms"),
            F.max("max_latency_ms").alias("max_latency_ms"),
        )
        .orderBy(*group_by, "bucket_offset_ms")
    )


def compare_frameworks(t, warmup_seconds: float = 0.0, frameworks=("spark", "flink")) -> DataFrame:
    """Frameworks side by side per (scenario, mode, fault action): every metric of the group aggregate with
    its confidence interval, null where a framework has no run. The fault service
    differs by framework, so it is not a grouping key."""
    dims = ["scenario", "mode", "fault_action"]
    sel = selected_runs(t).select("run_id", "first_ts", "framework", *dims)
    per_run = per_run_stats(t, sel, warmup_seconds)
    agg = with_ci95(per_run.groupBy(*dims, "framework").agg(*_across_runs()), "avg_of_run_avg_latency_ms",
                    "stddev_of_run_avg_latency_ms", "run_count", "avg_of_run_avg_latency")
    metrics = [c for c in agg.columns if c not in (*dims, "framework")]
    out = agg.groupBy(*dims).agg(*[
        F.max(F.when(F.col("framework") == fw, F.col(m))).alias(f"{fw}_{m}") for fw in frameworks for m in metrics
    ])
    return out.withColumns({f"{fw}_run_count": F.coalesce(F.col(f"{fw}_run_count"), F.lit(0).cast("long")) for fw in frameworks})


def compare_framework_series(t, bucket_seconds: float = 5.0, warmup_seconds: float = 0.0, frameworks=("spark", "flink")) -> DataFrame:
    """The frameworks' latency and throughput series side by side per (scenario, mode, fault action, offset)."""
    dims = ["scenario", "mode", "fault_action"]
    series = aggregate_latency_series(t, None, bucket_seconds, warmup_seconds, group_by=["framework", *dims])
    metrics = [c for c in series.columns if c not in ("framework", *dims, "bucket_offset_ms")]
    out = series.groupBy(*dims, "bucket_offset_ms").agg(*[
        F.max(F.when(F.col("framework") == fw, F.col(m))).alias(f"{fw}_{m}") for fw in frameworks for m in metrics
    ])
    return out.orderBy(*dims, "bucket_offset_ms")
