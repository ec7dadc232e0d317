"""Randomized invariants (hypothesis, few examples: each one runs Spark jobs)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latencylab.functions.columns import bucket_floor
from latencylab.operators import metrics, recovery, rollup, summary

EVENTS = "run_id string, framework string, scenario string, event_id long, sent_at_ms long, " \
         "processed_at_ms long, collected_at_ms long, latency_ms double"

rows = st.lists(
    st.tuples(
        st.sampled_from(["spark_low_01", "flink_high_02"]),
        st.integers(min_value=1, max_value=400),          # event id (duplicates and holes happen)
        st.integers(min_value=0, max_value=60_000),       # arrival offset in ms
        st.one_of(st.none(), st.integers(min_value=0, max_value=90_000)),  # latency, sometimes > 60 s
    ),
    min_size=1, max_size=120,
)

SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def _frame(spark, data):
    base = 1_700_000_000_000
    out = [(r, r.split("_")[0], r.split("_")[1], e, base + c - 10, base + c - 5, base + c,
            None if lat is None else float(lat)) for r, e, c, lat in data]
    return spark.createDataFrame(out, EVENTS)


@SETTINGS
@given(rows)
def test_rollup_and_loss_invariants(spark, data):
    ev = _frame(spark, data)
    starts = rollup.run_starts(ev)
    fine = rollup.bucket_rollup(ev, starts, 0.5)
    coarse = rollup.bucket_rollup(ev, starts, 5.0)
    n = ev.count()
    assert fine.agg(F.sum("messages")).first()[0] == n
    assert coarse.agg(F.sum("messages")).first()[0] == n
    # re-bucketing 0.5 s -> 5 s conserves counts per coarse bucket
    re = fine.withColumn("b", bucket_floor("bucket_offset_ms", 5000)).groupBy("run_id", "b").agg(
        F.sum("messages").alias("m"))
    direct = coarse.select("run_id", F.col("bucket_offset_ms").alias("b"), F.col("messages").alias("m"))
    assert re.exceptAll(direct).count() == 0 and direct.exceptAll(re).count() == 0
    loss = summary.loss_duplication(ev).collect()
    missing = {r.run_id: r for r in loss}
    listed = {r.run_id: r["count"] for r in recovery.missing_ids(ev).groupBy("run_id").count().collect()}
    for r in loss:
        assert r.missing_event_ids + r.distinct_events == r.max_event_id - r.min_event_id + 1
        assert r.duplicate_messages == r.messages - r.distinct_events
        assert listed.get(r.run_id, 0) == missing[r.run_id].missing_event_ids


@SETTINGS
@given(rows)
def test_histogram_is_cumulative(spark, data):
    ev = _frame(spark, data)
    h = metrics.latency_histogram(ev).collect()
    observed = {}
    for r in h:
        observed.setdefault(r.run_id, []).append((r.le, r.cumulative_count))
    counts = {r.run_id: r.messages_collected_total for r in metrics.messages_counter(ev).collect()}
    for run, pts in observed.items():
        pts.sort()
        assert all(a[1] <= b[1] for a, b in zip(pts, pts[1:]))
        assert pts[-1][1] == counts[run]


@SETTINGS
@given(rows)
def test_gap_series_covers_every_consecutive_pair(spark, data):
    ev = _frame(spark, data)
    gaps = recovery.gap_series(ev, target_rows=3)  # small blocks: many carries across blocks
    per_run = {r.run_id: r["count"] for r in ev.groupBy("run_id").count().collect()}
    got = {r.run_id: r["count"] for r in gaps.groupBy("run_id").count().collect()}
    for run, n in per_run.items():
        assert got.get(run, 0) == n - 1
    assert gaps.where("gap_ms < 0").count() == 0
