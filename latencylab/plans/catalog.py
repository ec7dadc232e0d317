"""Registered queries: one per operator of the inventory, each (spark, sf_dir) -> DataFrame.

Each query reads the driver's tables through ``Tables`` (derived lazily from
``events``), runs the library operators over whole tables, and rounds double
columns to 6 decimals so results compare across engines.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from latencylab.operators import metrics, parse, recovery, resources, rollup, rules, running, runs, series, summary
from latencylab.operators.output import from_output, to_output
from latencylab.operators.scan import sequence_number
from latencylab.schemas import PAYLOAD_NAMES
from latencylab.sources.fixtures import Tables

DIGITS = 6
GROUP_DIMS = runs.GROUP_DIMS
SERIES_BUCKET_SECONDS = 10.0
WARMUP_SECONDS = 30.0
AGG_WARMUP_SECONDS = 10.0
SELECTED = runs.RunFilter(
    framework="flink", run_ids=("flink_high_01", "flink_high_03", "flink_fault_high_02", "flink_low_05")
)

_TABLES: dict = {}
_LOCK = threading.Lock()


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables of a data folder; the derived tables are written once to the store
    (set LATENCYLAB_STORE=0 to plan everything from the raw tables instead)."""
    key = (id(spark), sf_dir)
    with _LOCK:  # one store build even when queries are started from several threads
        if key not in _TABLES:
            t = Tables(spark, sf_dir)
            if os.environ.get("LATENCYLAB_STORE", "1") != "0":
                t.materialize()
            _TABLES[key] = t
        return _TABLES[key]


def finalize(df: DataFrame) -> DataFrame:
    """Round every double column (engines may differ in the last bits of sums) and
    present NaN as null, so results hash the same in any engine or client."""
    cols = [
        F.round(F.nanvl(F.col(f.name), F.lit(None).cast("double")), DIGITS).alias(f.name)
        if isinstance(f.dataType, DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


# -- events, rules, running metrics -------------------------------------------------

def q_parse_events(spark, sf):
    t = tables(spark, sf)
    published = parse.envelope_json(t.transactions).select("value")
    foreign = t.read("events").select(F.col("props").alias("value"))  # JSON without the contract
    return parse.parse_events(published.unionByName(foreign), flatten=True)


def q_latency_enrich(spark, sf):
    t = tables(spark, sf)
    pe = t.processed_events_all.withColumn("stored", F.col("latency_ms").cast("string")).drop("latency_ms")
    out = parse.latency_enrich(pe, processed_at="processed_at_ms")
    return out.select(
        "run_id", "event_id", "sent_at_ms", "processed_at_ms", "collected_at_ms", "latency_ms",
        F.col("stored").try_cast("double").alias("stored_latency_ms"),
    )


def q_clean_nan(spark, sf):
    return parse.clean_nan(tables(spark, sf).resource_samples)


def q_payload_defaults(spark, sf):
    d = parse.payload_defaults(tables(spark, sf).transactions)
    return d.select("run_id", "event_id", "AccountID", "TransactionAmount", "TransactionType", "Channel",
                    "CustomerAge", "LoginAttempts")


def q_event_envelope(spark, sf):
    env = parse.event_envelope(tables(spark, sf).transactions)
    return env.select("key", "event.run_id", "event.event_id", "event.sent_at_ms", "event.scenario",
                      *[F.col(f"event.payload.{n}").alias(n) for n in PAYLOAD_NAMES])


def q_replay_sample(spark, sf):
    src = tables(spark, sf).fx_base.select("src_id", "user_id", "event_type", "value")
    return parse.replay_sample(src, "src_id", seed=42)


def _rules(t, profile=rules.DEFAULT_RULES, lenient=False):
    tx = t.transactions
    if lenient:
        tx = parse.payload_defaults(tx)
    return rules.apply_fraud_rules(tx, profile)


def q_fraud_rules(spark, sf):
    r = _rules(tables(spark, sf))
    return r.select("run_id", "event_id", "is_high_amount", "is_channel_mismatch", "is_age_anomaly", "is_fraud")


def q_fraud_rules_strict_age(spark, sf):
    r = _rules(tables(spark, sf), rules.STRICT_AGE_RULES, lenient=True)
    return r.select("run_id", "event_id", "is_high_amount", "is_channel_mismatch", "is_age_anomaly", "is_fraud")


def q_account_metrics(spark, sf):
    return running.account_metrics(_rules(tables(spark, sf)))


def q_window_metrics(spark, sf):
    return running.window_metrics(_rules(tables(spark, sf)))


def q_account_running(spark, sf):
    r = _rules(tables(spark, sf), rules.STRICT_AGE_RULES, lenient=True)
    out = running.account_running(r, empty_is_unknown=True)
    return out.select("run_id", "event_id", "metric_account_id", "account_transaction_count", "account_total_amount",
                      "account_avg_amount", "account_fraud_count", "account_max_amount")


def q_window_running(spark, sf):
    r = _rules(tables(spark, sf), rules.STRICT_AGE_RULES, lenient=True)
    out = running.window_running(r, empty_is_unknown=True)
    return out.select("run_id", "event_id", "window_bucket_ms", "window_transaction_count", "window_total_amount",
                      "window_avg_amount", "window_fraud_count")


def q_account_batch_cumulative(spark, sf):
    out = running.account_batch_cumulative(_rules(tables(spark, sf)))
    return out.select("run_id", "event_id", "batch_id", "account_transaction_count", "account_total_amount",
                      "account_avg_amount", "account_fraud_count")


ENRICHED_COLUMNS = [
    "run_id", "event_id", "is_fraud", "window_bucket_ms",
    "window_transaction_count", "window_total_amount", "window_avg_amount", "window_fraud_count",
    "account_transaction_count", "account_total_amount", "account_avg_amount", "account_fraud_count",
]


def q_enriched_running(spark, sf):
    return running.add_running_metrics(_rules(tables(spark, sf)), grain="batch").select(*ENRICHED_COLUMNS)


def q_output_records(spark, sf):
    t = tables(spark, sf)
    stamped = t.transactions.join(
        t.fx_kept.select("run_id", "event_id", "processed_at_ms"), ["run_id", "event_id"]
    )
    enriched = parse.latency_enrich(rules.apply_fraud_rules(stamped), processed_at="processed_at_ms")
    return from_output(to_output(running.add_running_metrics(enriched, grain="batch"), framework="spark"))


def q_enriched_running_event(spark, sf):
    r = _rules(tables(spark, sf), rules.STRICT_AGE_RULES, lenient=True)
    out = running.add_running_metrics(r, grain="event", empty_is_unknown=True)
    return out.select(*ENRICHED_COLUMNS, "account_max_amount")


def q_lenient_events(spark, sf):
    t = tables(spark, sf)
    loose = t.transactions.withColumns({  # numbers as text or with a fraction, as some producers send them
        "event_id": F.col("event_id").cast("string"), "TransactionAmount": F.col("TransactionAmount").cast("string"),
        "CustomerAge": F.concat(F.col("CustomerAge").cast("string"), F.when(F.col("event_id") % 2 == 0, ".0").otherwise("")),
    })
    out = rules.apply_fraud_rules(parse.parse_events_lenient(parse.envelope_json(loose).select("value")), rules.STRICT_AGE_RULES)
    return out.select("run_id", "event_id", "sent_at_ms", "scenario", "AccountID", "TransactionAmount", "TransactionType", "Channel",
                      "CustomerAge", "LoginAttempts", "is_high_amount", "is_channel_mismatch", "is_age_anomaly", "is_fraud")


def q_decode_collected(spark, sf):
    from latencylab.streaming.collect import decode_records

    kept = tables(spark, sf).fx_kept
    half = F.when(F.col("event_id") % 3 == 0, F.col("latency_ms") + 0.5).otherwise(F.col("latency_ms"))
    record = kept.withColumns({"event_id": F.col("event_id").cast("string"), "latency_ms": half.cast("string")})
    value = F.to_json(F.struct("framework", "run_id", "event_id", "sent_at_ms", "processed_at_ms", "latency_ms", "scenario"))
    return decode_records(record.select(value.alias("value"), "collected_at_ms"), "collected_at_ms")


# -- rollups and the run model --------------------------------------------------

def q_run_dim(spark, sf):
    return runs.run_dim(tables(spark, sf).runs)


def q_parse_run_id(spark, sf):
    from latencylab.functions.columns import parse_run_id, split_iteration

    ids = tables(spark, sf).processed_events_all.select("run_id").distinct()
    p = parse_run_id("run_id")
    return ids.select("run_id", p["framework"].alias("framework"), p["scenario"].alias("scenario"),
                      p["iteration"].alias("iteration"), split_iteration("run_id").alias("split_iteration"))


def q_scenario_volume(spark, sf):
    from latencylab.sources.readers import scenario_volume

    t = tables(spark, sf)
    saved = t.processed_events_all.groupBy("run_id").agg(F.count(F.lit(1)).alias("saved_messages"))
    volume = scenario_volume(t.run_metadata.select("run_id", "scenario", "eps", F.col("duration_seconds").alias("duration")))
    return volume.withColumnRenamed("duration", "duration_seconds").join(saved, "run_id").withColumn(
        "completeness", F.col("saved_messages") / F.col("expected_events").cast("double")
    )


def q_next_iteration_full(spark, sf):
    return runs.next_iteration(tables(spark, sf), max_iteration=2)


def q_next_iteration(spark, sf):
    return runs.next_iteration(tables(spark, sf))


def _all_events(t):
    return t.processed_events_all.drop("iteration")


def q_bucket_rollup(spark, sf):
    t = tables(spark, sf)
    return rollup.bucket_rollup(_all_events(t), t.starts_all, 5.0)


def q_run_rollup(spark, sf):
    t = tables(spark, sf)
    return rollup.run_rollup(_all_events(t), t.starts_all)


def q_run_start_alignment(spark, sf):
    t = tables(spark, sf)
    return rollup.run_starts(t.processed_events_all, t.run_metadata)


def q_upsert_latest_wins(spark, sf):
    t = tables(spark, sf)
    first = t.fx_kept.drop("iteration")  # the earlier flush: before duplicate deliveries arrived
    later = _all_events(t)
    v1 = rollup.bucket_rollup(first, rollup.run_starts(first, t.run_metadata)).withColumn("version", F.lit(1))
    v2 = rollup.bucket_rollup(later, rollup.run_starts(later, t.run_metadata)).withColumn("version", F.lit(2))
    return rollup.latest_wins(v1.unionByName(v2), ["run_id", "bucket_offset_ms"], ["version"])


def q_run_sources(spark, sf):
    return runs.event_runs(tables(spark, sf))


def q_run_exists(spark, sf):
    t = tables(spark, sf)
    return runs.run_exists(t, t.runs)


def q_fault_summary(spark, sf):
    return runs.fault_summary(tables(spark, sf).fault_events)


def q_run_list(spark, sf):
    return runs.run_list(tables(spark, sf))


def q_run_list_filtered(spark, sf):
    return runs.run_list(tables(spark, sf), runs.RunFilter(framework="spark", mode="fault"))


def q_run_groups(spark, sf):
    return runs.run_groups(tables(spark, sf))


def q_run_events_scan(spark, sf):
    t = tables(spark, sf)
    ev = runs.keep_run(_all_events(t), None).select("run_id", "event_id", "sent_at_ms", "collected_at_ms", "latency_ms")
    return sequence_number(ev, ["run_id"], ["collected_at_ms", "event_id"], name="arrival_seq")


def q_run_events_one(spark, sf):
    from latencylab.sources.readers import read_run_events

    t = tables(spark, sf)
    return read_run_events(spark, None, runs.keep_run(_all_events(t), "spark_high_03"), "spark_high_03")


def q_run_windows_by_start(spark, sf):
    return resources.run_windows_by_start(tables(spark, sf))


# -- summaries, series, group aggregates ------------------------------------------

def q_run_summary(spark, sf):
    return summary.run_summary(tables(spark, sf), 0.0)


def q_run_summary_warmup(spark, sf):
    return summary.run_summary(tables(spark, sf), WARMUP_SECONDS)


def q_run_summary_bucket(spark, sf):
    return summary.run_summary_bucket(tables(spark, sf), 0.0)


def q_loss_duplication(spark, sf):
    return summary.loss_duplication(_all_events(tables(spark, sf)))


def q_ci95_runs(spark, sf):
    return summary.ci95_runs(_all_events(tables(spark, sf)))


def q_compare_runs(spark, sf):
    return summary.compare_by_scenario(tables(spark, sf), 0.0)


def q_compare_runs_warmup(spark, sf):
    return summary.compare_by_scenario(tables(spark, sf), WARMUP_SECONDS)


def q_compare_two_runs(spark, sf):
    return summary.compare_two_runs(tables(spark, sf), "spark_low_01", "flink_fault_high_03")


def q_compare_framework_series(spark, sf):
    return series.compare_framework_series(tables(spark, sf), SERIES_BUCKET_SECONDS, 0.0)


def q_compare_frameworks(spark, sf):
    return series.compare_frameworks(tables(spark, sf), 0.0)


def q_latency_series_raw(spark, sf):
    return series.latency_series_raw(tables(spark, sf), SERIES_BUCKET_SECONDS, 0.0)


def q_latency_series_bucket(spark, sf):
    return series.latency_series_bucket(tables(spark, sf), SERIES_BUCKET_SECONDS, 0.0)


def q_latency_series(spark, sf):
    return series.latency_series(tables(spark, sf), SERIES_BUCKET_SECONDS, 0.0)


def q_aggregate_runs(spark, sf):
    return series.aggregate_runs(tables(spark, sf), None, AGG_WARMUP_SECONDS, group_by=GROUP_DIMS)


def q_aggregate_selected(spark, sf):
    return series.aggregate_runs(tables(spark, sf), SELECTED, 0.0)


def q_aggregate_run_table(spark, sf):
    """The aggregate over the runs of a table of ids: those that have a fault log."""
    t = tables(spark, sf)
    return series.aggregate_runs(runs.SelectedTables(t, t.fault_events.select("run_id")), None, 0.0, group_by=GROUP_DIMS)


def q_aggregate_latency_series(spark, sf):
    return series.aggregate_latency_series(tables(spark, sf), None, SERIES_BUCKET_SECONDS, 0.0, group_by=GROUP_DIMS)


# -- recovery ----------------------------------------------------------------------

def q_gap_series(spark, sf):
    return recovery.gap_series(_all_events(tables(spark, sf)))


def q_gap_stats(spark, sf):
    return recovery.gap_stats(recovery.gap_series(_all_events(tables(spark, sf))))


def q_missing_ranges(spark, sf):
    return recovery.missing_ranges(_all_events(tables(spark, sf)))


def q_missing_ids(spark, sf):
    return recovery.missing_ids(_all_events(tables(spark, sf)))


def q_fault_intervals(spark, sf):
    return recovery.fault_intervals(tables(spark, sf).fault_events)


def q_fault_attempts(spark, sf):
    return recovery.fault_attempts(tables(spark, sf).fault_events)


def q_fault_timeline(spark, sf):
    return summary.fault_timeline(tables(spark, sf))


def q_fault_gaps(spark, sf):
    t = tables(spark, sf)
    return recovery.fault_gaps(recovery.gap_series(_all_events(t)), recovery.fault_intervals(t.fault_events))


def q_fault_latency_sections(spark, sf):
    t = tables(spark, sf)
    return recovery.fault_latency_sections(_all_events(t), recovery.fault_intervals(t.fault_events), 15.0, 0.0)


def q_fault_attempt_sections(spark, sf):
    t = tables(spark, sf)
    return recovery.fault_attempt_sections(_all_events(t), recovery.fault_attempts(t.fault_events), 15.0, 0.0)


# -- resources and live metrics ------------------------------------------------------

def q_metric_align(spark, sf):
    t = tables(spark, sf)
    rw = resources.run_windows(t)
    mem = resources.align_metric_series(
        resources.docker_resource_total(t.resource_samples).drop("series"), rw, "memory_working_set_bytes"
    ).select("run_id", F.lit("memory").alias("metric"), "bucket_offset_ms",
             F.col("memory_working_set_bytes").alias("value"))
    cpu = resources.align_metric_series(resources.counter_rate(t.resource_samples), rw, "cpu_usage_cores").select(
        "run_id", F.lit("cpu").alias("metric"), "bucket_offset_ms", F.col("cpu_usage_cores").alias("value")
    )
    return mem.unionByName(cpu)


def q_resource_merge(spark, sf):
    return resources.resource_usage_buckets(tables(spark, sf))


def q_resource_series(spark, sf):
    return resources.resource_series(tables(spark, sf).resource_usage_buckets, SERIES_BUCKET_SECONDS, 0.0, 4.0)


def q_resource_overview(spark, sf):
    return resources.resource_overview(tables(spark, sf).resource_usage_buckets)


def q_aggregate_resource_series(spark, sf):
    t = tables(spark, sf)
    return resources.aggregate_resource_series(t, t.resource_usage_buckets, None, SERIES_BUCKET_SECONDS, 0.0, 4.0,
                                               group_by=GROUP_DIMS)


def q_docker_resource_total(spark, sf):
    total = resources.docker_resource_total(tables(spark, sf).resource_samples)
    return total.withColumn("is_nan", F.isnan("memory_working_set_bytes"))  # NaN itself is shown as null


def q_counter_rate(spark, sf):
    return resources.counter_rate(tables(spark, sf).resource_samples)


def q_rate_avg_latency(spark, sf):
    return metrics.rate_avg_latency(_all_events(tables(spark, sf)), 30.0)


def q_latency_histogram(spark, sf):
    return metrics.latency_histogram(_all_events(tables(spark, sf)))


def q_messages_counter(spark, sf):
    return metrics.messages_counter(_all_events(tables(spark, sf)))


def q_purge_run_counts(spark, sf):
    from latencylab.sinks.store import purge_counts

    return purge_counts(tables(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        return lambda spark, sf_dir: finalize(fn(spark, sf_dir))

    return {name: wrap(fn) for name, fn in QUERIES.items()}
