"""The run model: which stored source answers for a run, its dimensions, filters
and groups (AG8, AG11, AG15, JN3-JN5, JN16, PRJ17-PRJ22, PRJ32, ST1, SR1, SR3).

A run's events live in exactly one source by precedence: run summary, else raw
rows, else time buckets (``NOT EXISTS`` chains become ``left_anti`` joins on the
distinct run ids). Dimensions come from run metadata, else the events, else the
fault log. Everything is keyed by ``run_id`` so one plan answers for all runs;
dimension tables (one row per run) are joined without a forced broadcast and
AQE broadcasts them when their measured size is small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latencylab.functions.columns import split_iteration
from latencylab.operators.scan import percentiles


@dataclass(frozen=True)
class RunFilter:
    """Optional equality filters (None = no filter) and an optional run-id list."""

    framework: str | None = None
    scenario: str | None = None
    mode: str | None = None
    fault_service: str | None = None
    fault_action: str | None = None
    run_ids: tuple | None = field(default=None)


def _ids(df: DataFrame) -> DataFrame:
    return df.select("run_id").distinct()


def event_runs(t) -> DataFrame:
    """One row per run from the source that has precedence, with the source name.

    Columns: run_id, source, event_framework, event_scenario, messages,
    min_event_id, max_event_id, first_sent_at_ms, first_collected_at_ms,
    last_collected_at_ms, avg_latency_ms, p95_latency_ms, first_ts.
    """
    s = t.processed_run_summaries
    e = t.processed_events
    b = t.processed_event_buckets
    summary = s.select(
        "run_id", F.lit("summary").alias("source"),
        F.col("framework").alias("event_framework"), F.col("scenario").alias("event_scenario"),
        F.col("messages").cast("long").alias("messages"), "min_event_id", "max_event_id",
        "first_sent_at_ms", "first_collected_at_ms", "last_collected_at_ms", "avg_latency_ms", "p95_latency_ms",
        F.coalesce("first_sent_at_ms", "first_collected_at_ms").alias("first_ts"),
    )
    # labels are keys of the first aggregate (hash), so rows are read once and no string is aggregated over them
    labels = ["run_id", F.col("framework").alias("event_framework"), F.col("scenario").alias("event_scenario")]
    ends = ("min_event_id", "first_sent_at_ms", "first_collected_at_ms", "first_ts", "event_framework", "event_scenario")
    raw_rows = e.join(_ids(s), "run_id", "left_anti")
    raw = (
        raw_rows
        .groupBy(*labels)
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.min("event_id").alias("min_event_id"), F.max("event_id").alias("max_event_id"),
            F.min("sent_at_ms").alias("first_sent_at_ms"),
            F.min("collected_at_ms").alias("first_collected_at_ms"),
            F.max("collected_at_ms").alias("last_collected_at_ms"),
            F.sum("latency_ms").alias("latency_sum"), F.count("latency_ms").alias("latency_count"),
            F.min(F.coalesce("sent_at_ms", "collected_at_ms")).alias("first_ts"),
        )
        .groupBy("run_id")
        .agg(
            F.lit("raw").alias("source"), F.sum("messages").alias("messages"), *[F.min(c).alias(c) for c in ends],
            *[F.max(c).alias(c) for c in ("max_event_id", "last_collected_at_ms")],
            F.try_divide(F.sum("latency_sum"), F.sum("latency_count")).alias("avg_latency_ms"),
        )
        .join(percentiles(raw_rows, ["run_id"], "latency_ms", {"p95_latency_ms": ("cont", 0.95)}), "run_id", "left")
    )
    bucket_rows = b.join(_ids(s), "run_id", "left_anti").join(_ids(e), "run_id", "left_anti")
    buckets = (
        bucket_rows
        .groupBy(*labels)
        .agg(
            F.sum("messages").cast("long").alias("messages"),
            F.min("min_event_id").alias("min_event_id"), F.max("max_event_id").alias("max_event_id"),
            F.min("bucket_start_ms").alias("first_collected_at_ms"),
            F.max("bucket_end_ms").alias("last_collected_at_ms"),
            F.sum(F.col("avg_latency_ms") * F.col("messages")).alias("latency_sum"),
            F.sum("p95_latency_ms").alias("p95_sum"), F.count("p95_latency_ms").alias("p95_count"),
        )
        .groupBy("run_id")
        .agg(
            F.lit("buckets").alias("source"), F.sum("messages").alias("messages"),
            *[F.min(c).alias(c) for c in ends if c not in ("first_sent_at_ms", "first_ts")],
            F.min("first_collected_at_ms").alias("first_ts"), F.lit(None).cast("long").alias("first_sent_at_ms"),
            *[F.max(c).alias(c) for c in ("max_event_id", "last_collected_at_ms")],
            F.try_divide(F.sum("latency_sum"), F.nullif(F.sum("messages"), F.lit(0))).alias("avg_latency_ms"),
            F.try_divide(F.sum("p95_sum"), F.sum("p95_count")).alias("p95_latency_ms"),
        )
    )
    return summary.unionByName(raw).unionByName(buckets)


def fault_summary(fault_events: DataFrame) -> DataFrame:
    """Per run: service / action / count inferred from ``fault_start`` rows."""
    start = F.col("phase") == "fault_start"
    aggs = [
        F.max(F.when(start, F.col("service"))).alias("inferred_fault_service"),
        F.max(F.when(start, F.col("action"))).alias("inferred_fault_action"),
    ]
    if "count" in fault_events.columns:
        aggs.append(F.max(F.when(start, F.col("count"))).alias("inferred_fault_count"))
    else:
        aggs.append(F.lit(None).cast("int").alias("inferred_fault_count"))
    aggs += [
        F.count_if(start).alias("fault_start_count"),
        F.count_if(F.col("phase") == "fault_end").alias("fault_end_count"),
    ]
    return fault_events.groupBy("run_id").agg(*aggs)


def _meta_fault(c: str):
    return F.when(F.col("m_mode") == "normal", F.lit(None).cast("string")).otherwise(F.nullif(F.col(c), F.lit("")))


def resolve_dimensions(runs: DataFrame, metadata: DataFrame, faults: DataFrame | None,
                       framework_col: str = "event_framework", scenario_col: str = "event_scenario",
                       mode_by_pattern: bool = False) -> DataFrame:
    """Attach framework / scenario / iteration / mode / fault service / action.

    Metadata wins; else the events' values; iteration falls back to the third
    ``_`` part of the run id; mode falls back to fault-log presence (or, with
    ``mode_by_pattern``, to a ``_fault_`` run id).
    """
    m = metadata.select(
        "run_id",
        F.col("framework").alias("m_framework"), F.col("scenario").alias("m_scenario"),
        F.col("iteration").alias("m_iteration"), F.col("mode").alias("m_mode"),
        F.col("fault_service").alias("m_fault_service"), F.col("fault_action").alias("m_fault_action"),
        F.col("fault_count").alias("m_fault_count"), "eps", "duration_seconds", "max_events",
    )
    out = runs.join(m, "run_id", "left")
    if faults is not None:
        f = fault_summary(faults).select(
            "run_id", F.lit(True).alias("_has_faults"), "inferred_fault_service", "inferred_fault_action",
            "inferred_fault_count",
        )
        out = out.join(f, "run_id", "left")
    else:
        out = (out.withColumn("_has_faults", F.lit(None).cast("boolean"))
               .withColumn("inferred_fault_service", F.lit(None).cast("string"))
               .withColumn("inferred_fault_action", F.lit(None).cast("string"))
               .withColumn("inferred_fault_count", F.lit(None).cast("int")))
    if mode_by_pattern:
        fallback_mode = F.when(F.col("run_id").like("%_fault_%"), "fault").otherwise("normal")
    else:
        fallback_mode = F.when(F.col("_has_faults").isNull(), "normal").otherwise("fault")
    resolved = {
        "framework": F.coalesce("m_framework", framework_col),
        "scenario": F.coalesce("m_scenario", scenario_col),
        "iteration": F.coalesce(F.col("m_iteration"), split_iteration(F.col("run_id"))),
        "mode": F.coalesce(F.col("m_mode"), fallback_mode),
        # metadata writes '' (and a default action) even for normal runs: treat '' as
        # missing and normal runs as having no fault
        "fault_service": F.coalesce(_meta_fault("m_fault_service"), "inferred_fault_service"),
        "fault_action": F.coalesce(_meta_fault("m_fault_action"), "inferred_fault_action"),
        "fault_count": F.coalesce("m_fault_count", "inferred_fault_count"),
    }
    helper = {"m_framework", "m_scenario", "m_iteration", "m_mode", "m_fault_service", "m_fault_action",
              "m_fault_count", "_has_faults", "inferred_fault_service", "inferred_fault_action",
              "inferred_fault_count"}
    keep = [c for c in out.columns if c not in helper and c not in resolved]
    return out.select(*keep, *[v.alias(k) for k, v in resolved.items()])


def apply_filter(df: DataFrame, filt: RunFilter | None) -> DataFrame:
    """Add a predicate only for the filters that are set (no ``param is null or``)."""
    if filt is None:
        return df
    for name in ("framework", "scenario", "mode", "fault_service", "fault_action"):
        value = getattr(filt, name)
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    if filt.run_ids is not None:
        # a query parameter list: a literal IN (a few ids), pushed to the scan
        df = df.where(F.col("run_id").isin(*filt.run_ids))
    return df


def keep_run(df: DataFrame, run_id: str | None = None) -> DataFrame:
    """All runs, or one run (a pushed-down equality on the partition column)."""
    return df if run_id is None else df.where(F.col("run_id") == F.lit(run_id))


def selected_runs(t, filt: RunFilter | None = None) -> DataFrame:
    """Runs with resolved dimensions, filtered."""
    return apply_filter(resolve_dimensions(event_runs(t), t.run_metadata, t.fault_events), filt)


class SelectedTables:
    """The stored tables restricted to some runs, for any operator that takes the tables.

    ``runs`` is a table of run ids (of any length): every table is semi-joined with it before anything else, so that Spark's
    broadcast or runtime filter prunes the scans; or a short sequence of ids, which becomes a literal IN that reaches the scans."""

    def __init__(self, t, runs: DataFrame | Sequence[str]):
        self._tables = t
        self._runs = runs.select("run_id").distinct() if isinstance(runs, DataFrame) else tuple(runs)

    def __getattr__(self, name: str):
        value = getattr(self._tables, name)
        if not isinstance(value, DataFrame) or "run_id" not in value.columns:
            return value
        if isinstance(self._runs, DataFrame):
            return value.join(self._runs, "run_id", "left_semi")
        return value.where(F.col("run_id").isin(*self._runs))


RUN_LIST_COLUMNS = [
    "run_id", "framework", "scenario", "iteration", "mode", "fault_service", "fault_action", "fault_count",
    "eps", "duration_seconds", "max_events", "messages", "min_event_id", "max_event_id", "first_sent_at_ms",
    "first_collected_at_ms", "last_collected_at_ms", "avg_latency_ms", "p95_latency_ms",
]


def run_list(t, filt: RunFilter | None = None) -> DataFrame:
    """Run listing, newest last arrival first (nulls first, as the SQL store sorts)."""
    return selected_runs(t, filt).select(*RUN_LIST_COLUMNS).orderBy(F.col("last_collected_at_ms").desc_nulls_first())


GROUP_DIMS = ["framework", "scenario", "mode", "fault_service", "fault_action"]


def run_groups(t) -> DataFrame:
    """Runs per combination of the five dimensions (nulls form groups)."""
    return (
        selected_runs(t)
        .groupBy(*GROUP_DIMS)
        .agg(F.count(F.lit(1)).alias("run_count"))
        .orderBy(*[F.col(c).asc_nulls_last() for c in GROUP_DIMS])
    )


def run_exists(t, candidates: DataFrame) -> DataFrame:
    """For each candidate run id: present in summaries / buckets / raw rows."""
    flags = candidates.select("run_id").distinct()
    for name, df in (
        ("in_summaries", t.processed_run_summaries),
        ("in_buckets", t.processed_event_buckets),
        ("in_events", t.processed_events),
    ):
        flags = flags.join(_ids(df).withColumn(name, F.lit(True)), "run_id", "left").withColumn(
            name, F.coalesce(F.col(name), F.lit(False))
        )
    return flags.withColumn("run_exists", F.col("in_summaries") | F.col("in_buckets") | F.col("in_events"))


def run_exists_one(t, run_id: str) -> bool:
    """Existence check for one run: the first matching row of any event table
    (``limit(1)`` per table, run filter pushed to the scan)."""
    for df in (t.processed_run_summaries, t.processed_event_buckets, t.processed_events):
        if not df.where(F.col("run_id") == F.lit(run_id)).select("run_id").limit(1).isEmpty():
            return True
    return False


def compose_run_id(framework: Column, scenario: Column, iteration_number: Column) -> Column:
    """framework_scenario_NN with a zero-padded two-digit iteration."""
    return F.concat_ws("_", framework, scenario, F.lpad(iteration_number.cast("string"), 2, "0"))


def run_dim(runs: DataFrame) -> DataFrame:
    """Run id composed from its parts, and the scenario class (``fault_`` prefix)."""
    num = F.col("iteration").try_cast("int")
    return runs.select(
        "framework", "scenario", "iteration",
        compose_run_id(F.col("framework"), F.col("scenario"), num).alias("composed_run_id"),
        F.col("scenario").startswith("fault_").alias("is_fault_scenario"),
    )


def next_iteration(t, max_iteration: int = 99) -> DataFrame:
    """First free iteration 1..``max_iteration`` per (framework, scenario): a run id is taken when
    any stored table (raw, summary, buckets, metadata) has it. A combination without a free
    one stays, with null."""
    taken = (
        _ids(t.processed_events).unionByName(_ids(t.processed_run_summaries))
        .unionByName(_ids(t.processed_event_buckets)).unionByName(_ids(t.run_metadata)).distinct()
    )
    combos = selected_runs(t).select("framework", "scenario").distinct()
    cand = combos.select(
        "framework", "scenario", F.explode(F.sequence(F.lit(1), F.lit(max_iteration))).alias("n")
    ).withColumn("run_id", compose_run_id(F.col("framework"), F.col("scenario"), F.col("n")))
    marked = cand.join(taken.withColumn("_taken", F.lit(True)), "run_id", "left")
    return marked.groupBy("framework", "scenario").agg(
        F.lpad(F.min(F.when(F.col("_taken").isNull(), F.col("n"))).cast("string"), 2, "0").alias("next_iteration")
    )
