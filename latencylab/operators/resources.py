"""CPU and memory of the containers aligned to runs (SRC7, JN9, AG18-AG21,
AG25, AG26, PRJ28, PRJ33).

Metric samples ``(run_id, id, timestamp_ms, cpu_seconds_total, memory_bytes)``
stand in for the metrics server. The two server-side expressions are rebuilt as
DataFrame operators: a label-matched gauge sum, and a reset-aware counter rate
over a trailing 30-s range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latencylab.functions.columns import bucket_floor
from latencylab.operators.runs import RunFilter, apply_filter, event_runs, resolve_dimensions

# Container cgroup ids counted as Docker containers (full match).
DOCKER_CGROUP_PATTERN = r"/docker/.+|/system[.]slice/docker-.+[.]scope"
RATE_RANGE_MS = 30_000
RATE_BLOCK_MS = 3_600_000
DEFAULT_STEP_SECONDS = 5.0
RESOURCE_SOURCE = "prometheus:docker_total"


def _docker(samples: DataFrame, pattern: str) -> DataFrame:
    return samples.where(F.col("id").rlike(f"^(?:{pattern})$"))


def docker_resource_total(samples: DataFrame, value: str = "memory_bytes",
                          pattern: str = DOCKER_CGROUP_PATTERN, name: str = "memory_working_set_bytes") -> DataFrame:
    """Sum of a gauge across the matching series at each timestamp (a NaN sample
    makes the sum NaN, as in the metrics server)."""
    return _docker(samples, pattern).groupBy("run_id", "timestamp_ms").agg(
        F.sum(value).alias(name), F.count(F.lit(1)).alias("series")
    )


def counter_rate(samples: DataFrame, value: str = "cpu_seconds_total", pattern: str = DOCKER_CGROUP_PATTERN,
                 range_ms: int = RATE_RANGE_MS, name: str = "cpu_usage_cores") -> DataFrame:
    """Per-second rate of a counter over the trailing range ``(t - range, t]``,
    summed over the matching series.

    Per series: increase of a sample = v - previous v, or v after a reset (a
    drop). Rate at t = increases of the samples after the first one inside the
    range, divided by the seconds between the first and last sample inside it;
    null with fewer than two samples. A series is cut into blocks of ``RATE_BLOCK_MS``; each block
    also gets the samples of the range before it, so a long series is many window partitions.
    """
    s = _docker(samples, pattern).select("run_id", "id", "timestamp_ms", F.col(value).alias("v"))
    own, late = F.floor(F.col("timestamp_ms") / RATE_BLOCK_MS), F.pmod("timestamp_ms", F.lit(RATE_BLOCK_MS)) > RATE_BLOCK_MS - range_ms
    s = s.withColumn("_own", own).withColumn("_blk", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("run_id", "id", "_blk").orderBy("timestamp_ms")
    prev = F.lag("v").over(w)
    s = s.withColumn("inc", F.when(prev.isNull(), F.lit(0.0)).when(F.col("v") >= prev, F.col("v") - prev).otherwise(F.col("v")))
    r = w.rangeBetween(-(range_ms - 1), 0)
    s = s.select(
        "run_id", "id", "timestamp_ms", (F.col("_blk") == F.col("_own")).alias("_mine"),
        (F.sum("inc").over(r) - F.first("inc").over(r)).alias("increase"),
        F.count(F.lit(1)).over(r).alias("n"),
        ((F.max("timestamp_ms").over(r) - F.min("timestamp_ms").over(r)) / F.lit(1000.0)).alias("span_s"),
    )
    s = s.where("_mine").withColumn("rate", F.when((F.col("n") >= 2) & (F.col("span_s") > 0), F.col("increase") / F.col("span_s")))
    return s.groupBy("run_id", "timestamp_ms").agg(F.sum("rate").alias(name))


def run_windows(t, filt: RunFilter | None = None) -> DataFrame:
    """Runs with a start and a last arrival, dimensions resolved (mode by run-id
    pattern when there is no metadata)."""
    er = event_runs(t).select(
        "run_id", "event_framework", "event_scenario", F.col("first_ts").alias("run_start_at_ms"),
        "first_collected_at_ms", "last_collected_at_ms",
    )
    runs = resolve_dimensions(er, t.run_metadata, None, mode_by_pattern=True)
    runs = apply_filter(runs, filt)
    return runs.where(F.col("run_start_at_ms").isNotNull() & F.col("last_collected_at_ms").isNotNull()).select(
        "run_id", "framework", "scenario", "mode", "run_start_at_ms", "first_collected_at_ms", "last_collected_at_ms"
    )


def run_windows_by_start(t, filt: RunFilter | None = None) -> DataFrame:
    """The same runs ordered by start (the export order)."""
    return run_windows(t, filt).orderBy("run_start_at_ms")


def align_metric_series(series: DataFrame, runs: DataFrame, value: str) -> DataFrame:
    """Series samples inside [run start, last arrival] as offsets from the run start:
    non-finite values dropped, negative offsets clamped to 0, last sample wins per
    offset."""
    j = series.join(runs.select("run_id", "run_start_at_ms", "last_collected_at_ms"), "run_id").where(
        (F.col("timestamp_ms") >= F.col("run_start_at_ms")) & (F.col("timestamp_ms") <= F.col("last_collected_at_ms"))
    )
    v = F.col(value)
    j = j.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    j = j.withColumn("bucket_offset_ms", F.greatest(F.lit(0).cast("long"), F.col("timestamp_ms") - F.col("run_start_at_ms")))
    return j.groupBy("run_id", "bucket_offset_ms").agg(F.max_by(v, F.col("timestamp_ms")).alias(value))


def merge_resources(memory: DataFrame, cpu: DataFrame, runs: DataFrame,
                    step_seconds: float = DEFAULT_STEP_SECONDS) -> DataFrame:
    """Memory and CPU points on the union of their offsets (full outer join)."""
    step = int(step_seconds * 1000)
    both = memory.join(cpu, ["run_id", "bucket_offset_ms"], "full")
    out = both.join(runs.select("run_id", "framework", "scenario", "run_start_at_ms"), "run_id")
    return out.select(
        "run_id", "framework", "scenario", "bucket_offset_ms",
        (F.col("run_start_at_ms") + F.col("bucket_offset_ms")).alias("bucket_start_ms"),
        (F.col("run_start_at_ms") + F.col("bucket_offset_ms") + F.lit(step)).alias("bucket_end_ms"),
        "memory_working_set_bytes", "cpu_usage_cores", F.lit(RESOURCE_SOURCE).alias("source"),
    )


def resource_usage_buckets(t, filt: RunFilter | None = None, step_seconds: float = DEFAULT_STEP_SECONDS) -> DataFrame:
    """The stored resource table: aligned memory and CPU points per run."""
    runs = run_windows(t, filt)
    samples = t.resource_samples
    mem = align_metric_series(docker_resource_total(samples).drop("series"), runs, "memory_working_set_bytes")
    cpu = align_metric_series(counter_rate(samples), runs, "cpu_usage_cores")
    return merge_resources(mem, cpu, runs, step_seconds)


def _resource_aggs(total_cores: float):
    cores = F.lit(float(total_cores))
    return [
        F.avg("memory_working_set_bytes").alias("avg_memory_working_set_bytes"),
        F.max("memory_working_set_bytes").alias("max_memory_working_set_bytes"),
        F.avg("cpu_usage_cores").alias("avg_cpu_usage_cores"),
        F.max("cpu_usage_cores").alias("max_cpu_usage_cores"),
        (F.avg("cpu_usage_cores") * F.lit(100.0) / cores).alias("avg_cpu_usage_percent"),
        (F.max("cpu_usage_cores") * F.lit(100.0) / cores).alias("max_cpu_usage_percent"),
    ]


def resource_series(rub: DataFrame, bucket_seconds: float = 5.0, warmup_seconds: float = 0.0,
                    total_cores: float = 4.0) -> DataFrame:
    """Per run and re-bucketed offset: avg / max memory and cores, CPU percent."""
    width, warm = int(bucket_seconds * 1000), int(warmup_seconds * 1000)
    r = rub.where(F.col("bucket_offset_ms") >= F.lit(warm)).withColumn(
        "bucket_offset_ms", bucket_floor("bucket_offset_ms", width)
    )
    return r.groupBy("run_id", "bucket_offset_ms").agg(
        F.min("bucket_start_ms").alias("bucket_start_ms"), *_resource_aggs(total_cores)
    ).orderBy("run_id", "bucket_offset_ms")


def resource_overview(rub: DataFrame) -> DataFrame:
    """Per run: points, CPU points (non-null), avg / max cores."""
    return rub.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.count("cpu_usage_cores").alias("cpu_points"),
        F.avg("cpu_usage_cores").alias("avg_cores"),
        F.max("cpu_usage_cores").alias("max_cores"),
    )


def aggregate_resource_series(t, rub: DataFrame, filt: RunFilter | None = None, bucket_seconds: float = 5.0,
                              warmup_seconds: float = 0.0, total_cores: float = 4.0,
                              group_by: Sequence[str] = ()) -> DataFrame:
    """Per offset across runs: per-run-bucket resource statistics, then averaged
    (max of maxima). Runs come from the resource table itself, dimensions
    resolved as for the run list."""
    width, warm = int(bucket_seconds * 1000), int(warmup_seconds * 1000)
    runs = rub.select("run_id", F.col("framework").alias("r_framework"), F.col("scenario").alias("r_scenario")).distinct()
    sel = resolve_dimensions(runs, t.run_metadata, t.fault_events, "r_framework", "r_scenario")
    sel = apply_filter(sel, filt).select("run_id", *group_by).distinct()
    per_run_bucket = (
        rub.where(F.col("bucket_offset_ms") >= F.lit(warm))
        .select("run_id", "bucket_offset_ms", "memory_working_set_bytes", "cpu_usage_cores")
        .join(sel, "run_id")
        .withColumn("bucket_offset_ms", bucket_floor("bucket_offset_ms", width))
        .groupBy("run_id", *group_by, "bucket_offset_ms")
        .agg(*_resource_aggs(total_cores))
    )
    return (
        per_run_bucket.groupBy(*group_by, "bucket_offset_ms")
        .agg(
            F.count(F.lit(1)).alias("run_count"),
            F.avg("avg_memory_working_set_bytes").alias("avg_memory_working_set_bytes"),
            F.max("max_memory_working_set_bytes").alias("max_memory_working_set_bytes"),
            F.avg("avg_cpu_usage_cores").alias("avg_cpu_usage_cores"),
            F.max("max_cpu_usage_cores").alias("max_cpu_usage_cores"),
            F.avg("avg_cpu_usage_percent").alias("avg_cpu_usage_percent"),
            F.max("max_cpu_usage_percent").alias("max_cpu_usage_percent"),
        )
        .orderBy(*group_by, "bucket_offset_ms")
    )
