"""Streaming: stream = batch, restart / replay, late data, collect job, keyed state."""

import os
import time

from pyspark.sql import functions as F

from latencylab.operators import rollup, rules, running
from latencylab.operators.parse import envelope_json, payload_defaults
from latencylab.streaming.pipeline import PipelineConfig, read_events_stream, read_output, start_pipeline
from tests.conftest import SF_SMALL


def _tx(spark):
    from latencylab.plans.catalog import tables

    return tables(spark, SF_SMALL).transactions


def _write_ordered_files(spark, tx, folder, parts=3):
    """Files with increasing event-id ranges and increasing mtimes (arrival order)."""
    os.makedirs(folder, exist_ok=True)
    bounds = [0, 40, 80, 10 ** 9][: parts + 1]
    for k in range(parts):
        part = tx.where((F.col("event_id") > bounds[k]) & (F.col("event_id") <= bounds[k + 1]))
        tmp = f"{folder}_tmp{k}"
        envelope_json(part).select("value").coalesce(1).write.text(tmp)
        name = [f for f in os.listdir(tmp) if f.endswith(".txt")][0]
        os.rename(f"{tmp}/{name}", f"{folder}/part{k}.txt")
        os.utime(f"{folder}/part{k}.txt", (time.time() + k, time.time() + k))


def _run(spark, src, root, grain="batch", tag="a", **options):
    cfg = PipelineConfig(output_dir=f"{root}/out_{tag}", grain=grain, **options)
    q = start_pipeline(read_events_stream(spark, "files", src, {"maxFilesPerTrigger": "1"}), cfg,
                       f"{root}/ck_{tag}", {"availableNow": True}, processed_at="sent_at_ms")
    q.awaitTermination()
    return cfg


def _same(a, b, cols, digits=6):
    pick = lambda d: d.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in d.select(*cols).dtypes])
    assert pick(a).exceptAll(pick(b)).count() == 0 and a.count() == b.count()


BOTH = [f"{f}_{c}" for f in ("account", "window") for c in ("transaction_count", "total_amount", "avg_amount", "fraud_count")]


def test_stream_equals_batch_per_event(spark, tmp_dir):
    """Running counts, amounts and maxima of both families; events without a send time included."""
    tx = _tx(spark)
    assert tx.where("sent_at_ms is null").count() > 0
    _write_ordered_files(spark, tx, f"{tmp_dir}/in")
    cfg = _run(spark, f"{tmp_dir}/in", tmp_dir, "event", "e", per_record=True, profile=rules.STRICT_AGE_RULES)
    out = read_output(spark, cfg.output_dir, cfg.schema)
    lenient = rules.apply_fraud_rules(payload_defaults(tx), rules.STRICT_AGE_RULES)
    ref = running.add_running_metrics(lenient, grain="event", empty_is_unknown=True)
    # values inside one micro-batch and key come in arrival order, which is that of the ids here
    _same(out, ref, ["run_id", "event_id", "is_fraud", "window_bucket_ms", *BOTH, "account_max_amount"])


def test_stream_equals_batch_per_micro_batch(spark, tmp_dir):
    tx = _tx(spark)
    _write_ordered_files(spark, tx, f"{tmp_dir}/in")
    cfg = _run(spark, f"{tmp_dir}/in", tmp_dir, "batch", "b")
    out = read_output(spark, cfg.output_dir)
    batch = F.when(F.col("event_id") <= 40, 0).when(F.col("event_id") <= 80, 1).otherwise(2).cast("long")
    ref = running.add_running_metrics(rules.apply_fraud_rules(tx.withColumn("batch_id", batch)), grain="batch")
    _same(out, ref, ["run_id", "event_id", "is_fraud", "window_bucket_ms", *BOTH])


def test_written_batch_replaces_its_replay(spark, tmp_dir):
    """A batch that is written again (a restart after output, before the commit) is there once."""
    from latencylab.streaming.pipeline import FOLDED, enriched, write_batch

    tx = _tx(spark).where("event_id <= 20")
    ev = enriched(envelope_json(tx).select("value"), PipelineConfig(output_dir=""), "sent_at_ms")
    n = ev.count()
    rec = ev.select(F.uuid().alias("uid"), F.to_json(F.struct(*ev.columns)).alias("record")).cache()
    rows = None
    for f in ("account", "window"):
        part = rec.select(F.lit(f).alias("family"), F.lit("k").alias("state_key"), "uid", "record", F.lit(1).cast("long").alias("transaction_count"),
                          F.lit(2.0).alias("total_amount"), F.lit(0).cast("long").alias("fraud_count"), F.lit(2.0).alias("max_amount"))
        rows = part if rows is None else rows.unionByName(part)
    assert rows.columns == [c.split()[0] for c in FOLDED.split(", ")]
    cfg = PipelineConfig(output_dir=f"{tmp_dir}/out", grain="event")
    for _ in range(2):
        write_batch(rows, 0, cfg, ev.schema)
    assert read_output(spark, cfg.output_dir).count() == n


def test_restart_continues_without_repeats(spark, tmp_dir):
    tx = _tx(spark)
    src = f"{tmp_dir}/in"
    _write_ordered_files(spark, tx, src, parts=2)
    cfg = _run(spark, src, tmp_dir, "batch", "r")
    n1 = read_output(spark, cfg.output_dir).count()
    # new file arrives; the query restarts from its checkpoint
    extra = tx.where("event_id > 80")
    envelope_json(extra).select("value").coalesce(1).write.text(f"{tmp_dir}/late")
    name = [f for f in os.listdir(f"{tmp_dir}/late") if f.endswith(".txt")][0]
    os.rename(f"{tmp_dir}/late/{name}", f"{src}/part9.txt")
    cfg = _run(spark, src, tmp_dir, "batch", "r")
    out = read_output(spark, cfg.output_dir)
    assert out.count() == n1 + extra.count() == tx.count()
    assert out.select("run_id", "event_id").distinct().count() == tx.count()


def test_late_rows_with_and_without_watermark(spark, tmp_dir):
    from latencylab.streaming.windows import window_metrics_stream

    def ev(i, ms):
        return f'{{"run_id":"r_x_01","event_id":{i},"sent_at_ms":{ms},"scenario":"low","payload":{{}}}}'

    counts = {}
    for wm in (None, "10 seconds"):
        tag = "none" if wm is None else "wm"
        src = f"{tmp_dir}/w_{tag}"
        os.makedirs(src)
        with open(f"{src}/a.txt", "w") as f:
            f.write("\n".join([ev(1, 100_000), ev(2, 200_000)]) + "\n")
        stream = read_events_stream(spark, "files", src, {"maxFilesPerTrigger": "1"})
        q = (window_metrics_stream(stream, "30 seconds", wm).writeStream.outputMode("update")
             .format("memory").queryName(f"w_{tag}").option("checkpointLocation", f"{tmp_dir}/ck_{tag}").start())
        q.processAllAvailable()
        with open(f"{src}/b.txt", "w") as f:
            f.write(ev(3, 105_000) + "\n")  # late by 95 s
        os.utime(f"{src}/b.txt", (time.time() + 5, time.time() + 5))
        q.processAllAvailable()
        counts[tag] = spark.sql(f"select max(transaction_count) as n from w_{tag} where bucket_start_ms = 90000").first().n
        q.stop()
    assert counts["none"] == 2  # counted forever without a watermark
    assert counts["wm"] == 1  # beyond the watermark: dropped


def _records(spark):
    """Collected output records as JSON, with their arrival time."""
    from latencylab.plans.catalog import tables

    pe = tables(spark, SF_SMALL).processed_events_all.drop("iteration")
    return pe.select(F.to_json(F.struct("framework", "run_id", "event_id", "sent_at_ms", "processed_at_ms", "latency_ms", "scenario")).alias("value"),
                     "collected_at_ms")


def _check_store(store, rows):
    starts = rollup.run_starts(rows)
    ref = rollup.bucket_rollup(rows, starts)
    _same(store.read("processed_event_buckets").select(*ref.columns), ref, ref.columns)
    ref = rollup.run_rollup(rows, starts)
    _same(store.read("processed_run_summaries").select(*ref.columns), ref, ref.columns)


def test_collect_job_matches_batch_rollups(spark, tmp_dir):
    """All statistics, with buckets touched twice, arrivals before the first one seen, and replays."""
    from latencylab.sinks.store import Store
    from latencylab.streaming.collect import CollectConfig, collect_batch, decode_records

    rec = _records(spark)
    store = Store(spark, f"{tmp_dir}/store")
    cfg = CollectConfig(mode="bucket", bucket_seconds=5.0, jsonl_path=f"{tmp_dir}/jsonl")
    batches = [rec.where("collected_at_ms % 4 = 3"), rec.where("collected_at_ms % 4 in (0, 1)"), rec.where("collected_at_ms % 4 = 2")]
    for i in (0, 1, 1, 2, 2):
        collect_batch(batches[i], i, store, cfg, collected_at="collected_at_ms")
    _check_store(store, decode_records(rec, "collected_at_ms"))
    assert spark.read.json(f"{tmp_dir}/jsonl").count() == rec.count()
    run = store.read("processed_run_summaries").first().run_id
    store.purge(run)
    assert store.read("collect_ids").where(F.col("run_id") == run).count() == 0


def test_collect_reads_only_the_touched_blocks(spark, tmp_dir):
    from latencylab.sinks.store import Store
    from latencylab.streaming.collect import CollectConfig, collect_batch

    rec = _records(spark)
    store = Store(spark, f"{tmp_dir}/store")
    collect_batch(rec, 0, store, CollectConfig(), collected_at="collected_at_ms")
    run, block = store.read("processed_events_log").select("run_id", "block").first()
    part = store.read_parts("processed_events_log", run_id=[run], block=[block])
    files = part.inputFiles()
    assert files and all(f"run_id={run}/block={block}/" in f for f in files)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "block" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_started_collect_query_restarts_from_its_checkpoint(spark, tmp_dir):
    from latencylab.sinks.store import Store
    from latencylab.streaming.collect import CollectConfig, decode_records, start_collect

    rec = _records(spark)
    whole = rec.select(F.to_json(F.struct("value", "collected_at_ms")).alias("value"))
    src, store = f"{tmp_dir}/in", Store(spark, f"{tmp_dir}/store")
    os.makedirs(src)
    for k, wanted in enumerate(("collected_at_ms % 3 = 0", "collected_at_ms % 3 = 1", "collected_at_ms % 3 = 2")):
        rec.where(wanted).select(F.to_json(F.struct("value", "collected_at_ms")).alias("v")).coalesce(1).write.text(f"{tmp_dir}/t{k}")
    assert whole.count() == rec.count()

    def deliver(k):
        name = [f for f in os.listdir(f"{tmp_dir}/t{k}") if f.endswith(".txt")][0]
        os.rename(f"{tmp_dir}/t{k}/{name}", f"{src}/part{k}.txt")

    def run():
        stream = read_events_stream(spark, "files", src, {"maxFilesPerTrigger": "1"})
        stream = stream.select(F.from_json("value", "value string, collected_at_ms long").alias("r")).select("r.*")
        q = start_collect(stream, store, CollectConfig(), f"{tmp_dir}/ck", {"availableNow": True}, collected_at="collected_at_ms")
        q.awaitTermination()

    deliver(0), deliver(1)
    run()
    deliver(2)
    run()
    _check_store(store, decode_records(rec, "collected_at_ms"))


def test_raw_mode_keeps_rows_of_one_run(spark, tmp_dir):
    from latencylab.sinks.store import Store
    from latencylab.streaming.collect import CollectConfig, collect_batch, decode_records

    rec = _records(spark)
    store = Store(spark, f"{tmp_dir}/raw")
    run = decode_records(rec, "collected_at_ms").first().run_id
    for _ in range(2):
        collect_batch(rec, 0, store, CollectConfig(mode="raw", run_id=run), collected_at="collected_at_ms")
    want = decode_records(rec, "collected_at_ms").where(F.col("run_id") == run)
    got = store.read("processed_events").drop("batch_id")
    _same(got, want, want.columns)
    assert not store.exists("processed_event_buckets")


def test_await_idle_counts_every_batch(spark, tmp_dir):
    from latencylab.streaming.collect import await_idle

    src = f"{tmp_dir}/in"
    os.makedirs(src)
    for k in range(6):
        with open(f"{src}/f{k}.txt", "w") as f:
            f.write("x\n" * (k + 1))
    q = (read_events_stream(spark, "files", src, {"maxFilesPerTrigger": "1"}).writeStream.foreachBatch(lambda df, i: df.count() and None)
         .option("checkpointLocation", f"{tmp_dir}/ck").start())
    assert await_idle(q, idle_seconds=4, poll_seconds=2.5) == 21
    assert not q.isActive
    q = (read_events_stream(spark, "files", src, {"maxFilesPerTrigger": "1"}).writeStream.foreachBatch(lambda df, i: (df.count(), time.sleep(0.4)) and None)
         .option("checkpointLocation", f"{tmp_dir}/ck2").start())
    assert 3 <= await_idle(q, idle_seconds=30, max_messages=3, poll_seconds=0.1) <= 21


def test_keyed_pandas_state(spark, tmp_dir):
    from latencylab.streaming.state import account_state_stream

    tx = _tx(spark)
    src = f"{tmp_dir}/in"
    _write_ordered_files(spark, tx, src, parts=3)
    stream = read_events_stream(spark, "files", src, {"maxFilesPerTrigger": "1"})
    q = (account_state_stream(stream).writeStream.outputMode("append").format("memory").queryName("acct_state")
         .option("checkpointLocation", f"{tmp_dir}/ck").start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("acct_state").select("run_id", "event_id", "account_transaction_count")
    from latencylab.operators.parse import payload_defaults

    ref = running.account_running(rules.apply_fraud_rules(payload_defaults(tx), rules.STRICT_AGE_RULES),
                                  empty_is_unknown=True).select("run_id", "event_id", "account_transaction_count")
    assert got.count() == tx.count()
    assert got.exceptAll(ref).count() == 0


def test_optional_dedupe_within_watermark(spark, tmp_dir):
    from latencylab.streaming.windows import dedupe_events

    src = f"{tmp_dir}/d"
    os.makedirs(src)
    line = '{"run_id":"r_x_01","event_id":1,"sent_at_ms":1000,"payload":{}}'
    with open(f"{src}/a.txt", "w") as f:
        f.write("\n".join([line, line, line.replace('"event_id":1', '"event_id":2')]) + "\n")
    q = (dedupe_events(read_events_stream(spark, "files", src), "1 minute").writeStream.format("memory")
         .queryName("dedup").option("checkpointLocation", f"{tmp_dir}/ck").start())
    q.processAllAvailable()
    q.stop()
    assert spark.table("dedup").count() == 2


def _one_run(spark, *batches):
    """Batches of output records of one run: ids, sent a second apart, arriving 100 ms later."""
    rec = 'to_json(named_struct("run_id", "spark_low_01", "framework", "spark", "scenario", "low", "event_id", id, "sent_at_ms", id * 1000, "latency_ms", 100.0)) as value'
    return [spark.createDataFrame([(i,) for i in ids], "id long").selectExpr(rec, "id * 1000 + 100 as collected_at_ms") for ids in batches]


def test_events_per_second_that_become_known_later_move_the_run(spark, tmp_dir):
    from latencylab.sinks.store import Store
    from latencylab.streaming.collect import CollectConfig, collect_batch, decode_records

    store = Store(spark, f"{tmp_dir}/store")
    batches = _one_run(spark, range(11, 30), range(30, 45))
    collect_batch(batches[0], 0, store, CollectConfig(), collected_at="collected_at_ms")
    assert store.read("collect_run_starts").first().run_start_ms == 11_000
    meta = spark.createDataFrame([("spark_low_01", 2.0, 5)], "run_id string, eps double, ver long")
    store.upsert("run_metadata", meta, ["run_id"], "ver")
    collect_batch(batches[1], 1, store, CollectConfig(), collected_at="collected_at_ms")
    assert store.read("collect_run_starts").first().run_start_ms == 11_000 - 5_000  # (11 - 1) / 2 s before
    rows = decode_records(batches[0].unionByName(batches[1]), "collected_at_ms")
    ref = rollup.bucket_rollup(rows, rollup.run_starts(rows, meta))
    _same(store.read("processed_event_buckets").select(*ref.columns), ref, ref.columns)


def test_collected_ids_are_bitmaps_with_the_same_counts_and_holes(spark, tmp_dir):
    from latencylab.operators.recovery import missing_ranges
    from latencylab.sinks.store import Store
    from latencylab.streaming.collect import CollectConfig, collect_batch, decode_records, seen_ids

    store = Store(spark, f"{tmp_dir}/store")
    ids = [-40_000, -1, 0, *range(1, 40), *range(32_760, 32_780), 3_000_000]
    batches = _one_run(spark, ids[::2], [*ids[1::2], 5, 6], [7, 3_000_001])
    for i in (0, 1, 1, 2, 2):
        collect_batch(batches[i], i, store, CollectConfig(), collected_at="collected_at_ms")
    want = sorted({*ids, 3_000_001})
    assert sorted(r.event_id for r in seen_ids(store, ["spark_low_01"]).collect()) == want
    summary = store.read("processed_run_summaries").first()
    assert (summary.distinct_events, summary.messages) == (len(want), len(ids) + 4)
    rows = decode_records(batches[0].unionByName(batches[1]).unionByName(batches[2]), "collected_at_ms")
    holes = lambda df: sorted(tuple(r) for r in missing_ranges(df).collect())
    assert holes(seen_ids(store, ["spark_low_01"])) == holes(rows)


def test_files_listed_per_batch_stay_few(spark, tmp_dir, monkeypatch):
    """After many batches a block that is over is one folder, and the open one at most as many as are merged at once."""
    from latencylab.sinks.store import Store
    from latencylab.streaming import collect

    monkeypatch.setattr(collect, "MERGE_FOLDERS", 3)
    store = Store(spark, f"{tmp_dir}/store")
    listed = []
    for i, batch in enumerate(_one_run(spark, *[range(1 + 12 * k, 13 + 12 * k) for k in range(9)])):
        collect.collect_batch(batch, i, store, collect.CollectConfig(), collected_at="collected_at_ms")
        run = store.folder("processed_events_log", run_id="spark_low_01")
        listed.append({b: len(store.children(f"{run}/{b}")) for b in store.children(run)})
    newest = max(int(b.split("=")[1]) for b in listed[-1])
    assert all(n <= collect.MERGE_FOLDERS + 1 for seen in listed for n in seen.values())
    assert all(n <= 2 for b, n in listed[-1].items() if int(b.split("=")[1]) < newest)
    assert len(listed[-1]) == 2 and any(n < 3 for n in listed[-1].values())
    assert store.read("processed_run_summaries").first().messages == 108


def test_bounded_run_counts_more_batches_than_spark_keeps(spark, tmp_dir):
    from latencylab.streaming.live import ProgressTotals, await_idle

    src = f"{tmp_dir}/in"
    os.makedirs(src)
    for k in range(14):
        with open(f"{src}/f{k}.txt", "w") as f:
            f.write("x\n" * (k + 1))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    totals = ProgressTotals()
    spark.streams.addListener(totals)
    try:
        q = (read_events_stream(spark, "files", src, {"maxFilesPerTrigger": "1"}).writeStream.format("noop")
             .option("checkpointLocation", f"{tmp_dir}/ck").start())
        assert await_idle(q, idle_seconds=5, poll_seconds=1.0, totals=totals) == sum(range(1, 15))
        assert len(totals.rows) >= 14 and not q.isActive
    finally:
        spark.streams.removeListener(totals)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_observed_histogram_equals_the_batch_one(spark, tmp_dir):
    from latencylab.operators.metrics import latency_histogram
    from latencylab.sinks.store import Store
    from latencylab.streaming.collect import CollectConfig, decode_records, start_collect
    from latencylab.streaming.live import LIVE, ProgressTotals

    rec = _records(spark)
    rec.select("value").repartition(2).write.text(f"{tmp_dir}/in")
    totals = ProgressTotals(LIVE)
    spark.streams.addListener(totals)
    try:
        stream = read_events_stream(spark, "files", f"{tmp_dir}/in", {"maxFilesPerTrigger": "1"})
        q = start_collect(stream, Store(spark, f"{tmp_dir}/store"), CollectConfig(mode="raw", live_metrics=True), f"{tmp_dir}/ck", {"availableNow": True})
        totals.follow(q)
        q.awaitTermination()
        deadline = time.time() + 20
        while len(totals.observed) < 2 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(totals)
    got = totals.histogram()
    rows = decode_records(rec, "collected_at_ms")
    want = {r.le: r.n for r in latency_histogram(rows).groupBy("le").agg(F.sum("cumulative_count").alias("n")).collect()}
    assert got["le"] == want and got["messages"] == rows.where("latency_ms is not null").count() > 0
