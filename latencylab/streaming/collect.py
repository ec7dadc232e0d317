"""Collect job (SS8-SS10, SNK2-SNK5, SNK10): stamp arrival, keep one run or all,
append raw rows, and maintain time-bucket and run-summary rollups.

The raw log is partitioned by run and time block. A batch rebuilds only the time buckets it touched, from
their blocks, and adds to the runs' state (first record, ids as bitmaps, counts of latency values), from which the
run summaries follow. A restart or replay never overwrites counts with partial ones, unlike an in-memory collector.

Folders are read by path, so a batch lists those of the blocks it touches and nothing else; the batch folders of a block are
merged when they pile up and when its time has passed. What still grows with a run is its counted latency
values, which every batch of the run reads and writes. Run metadata is looked up in each batch: a run whose events per second
become known later is rebuilt with its back-calculated start by its next batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.functions.columns import bucket_floor, lenient_double
from latencylab.operators.parse import as_text, lenient_long
from latencylab.operators.rollup import RANKS, aligned, bucket_rollup, run_labels, run_starts
from latencylab.operators.runs import keep_run
from latencylab.operators.scan import arg_extreme, percentiles
from latencylab.schemas import OUTPUT_RECORD
from latencylab.sinks.store import Store, write_jsonl
from latencylab.streaming.live import await_idle, observe_latencies

LOG_BLOCK_MS = 60_000
IDS_PER_BITMAP = 32_768  # fixed by Spark's bitmap functions
BITMAPS_PER_BLOCK = 64
MERGE_FOLDERS = 16  # batch folders of an open block that are merged
BUCKETS_PER_PART = 1000
SUMMARY_COLUMNS = ["run_id", "framework", "scenario", "messages", "distinct_events", "min_event_id", "max_event_id", "first_sent_at_ms",
                   "first_collected_at_ms", "last_collected_at_ms", "avg_latency_ms", "median_latency_ms", "p95_latency_ms", "max_latency_ms"]

RAW_COLUMNS = ["run_id", "framework", "scenario", "event_id", "sent_at_ms", "processed_at_ms", "collected_at_ms",
               "latency_ms"]


@dataclass
class CollectConfig:
    run_id: str | None = None
    mode: str = "bucket"  # "bucket": rollups (plus the raw log); "raw": raw rows only
    bucket_seconds: float = 5.0
    live_metrics: bool = False  # observe the message counter and latency histogram (see ``live.ProgressTotals``)
    jsonl_path: str | None = None  # also write each batch as JSON lines, a folder per run


def decode_records(df: DataFrame, collected_at: str | None = None) -> DataFrame:
    """Output-record JSON -> raw row, numbers read leniently (text and fractions too); stamps ``collected_at_ms`` (arrival time, once
    per micro-batch) unless a column supplies it."""
    cols = [F.from_json(F.col("value").cast("string"), as_text(OUTPUT_RECORD)).alias("r")]
    if collected_at is not None:
        cols.append(F.col(collected_at).alias("_c"))
    rec = df.select(*cols)
    stamp = F.col("_c") if collected_at is not None else F.expr("unix_millis(current_timestamp())")
    return rec.select(
        "r.run_id", "r.framework", "r.scenario",
        *[lenient_long(c, F.col(f"r.{c}")) for c in ("event_id", "sent_at_ms", "processed_at_ms")],
        stamp.cast("long").alias("collected_at_ms"),
        lenient_double(F.col("r.latency_ms")).alias("latency_ms"),
    ).where(F.col("run_id").isNotNull())


RUN_KEYS = ["run_id"]
__all__ = ["CollectConfig", "await_idle", "collect_batch", "decode_records", "seen_ids", "start_collect"]


def collect_batch(batch: DataFrame, batch_id: int, store: Store, cfg: CollectConfig,
                  metadata: DataFrame | None = None, collected_at: str | None = None) -> None:
    """Stores one micro-batch. Besides appending, it reads the log of the touched time blocks, the id bitmaps of the touched
    id blocks, and the runs' latency counts; ``metadata`` (run_id, eps) is the store's ``run_metadata`` as it is now, unless
    given. A replayed batch leaves the same tables."""
    rows = keep_run(decode_records(batch, collected_at), cfg.run_id).persist()
    try:
        if rows.isEmpty():
            return
        if cfg.jsonl_path:
            write_jsonl(rows, cfg.jsonl_path, batch_id)
        if cfg.mode == "raw":
            store.append("processed_events", rows, batch_id)
            return
        block = F.floor(F.col("collected_at_ms") / LOG_BLOCK_MS).cast("long")
        log_rows = rows.withColumn("block", block)
        store.append("processed_events_log", log_rows, batch_id, LOG_PARTS)
        starts, moved = _update_starts(rows, store, metadata)
        _update_buckets(rows, starts, moved, store, cfg)
        _update_summaries(rows, starts, batch_id, store)
        _merge_log(log_rows, batch_id, store)
    finally:
        rows.unpersist()


LOG_PARTS = ["run_id", "block"]


def _values(df: DataFrame, *columns: str) -> list[tuple]:
    """The distinct runs, or runs and blocks, that a micro-batch touched: a short list that names folders."""
    return [tuple(r) for r in df.where(F.col(columns[-1]).isNotNull()).select(*columns).distinct().collect()]


def _merge_log(log_rows: DataFrame, batch_id: int, store: Store) -> None:
    """Merges the batch folders of touched blocks that have many, and of the blocks before them, which are over.
    Only batches before this one are merged: this one may be replayed."""
    for run_id, block in _values(log_rows, *LOG_PARTS):
        store.merge_batches("processed_events_log", store.folder("processed_events_log", run_id=run_id, block=block), batch_id - 1, MERGE_FOLDERS)
        store.merge_batches("processed_events_log", store.folder("processed_events_log", run_id=run_id, block=block - 1), batch_id - 1)


def _whole_log(store: Store, runs: list[tuple]) -> DataFrame:
    """All blocks of some runs."""
    parts = [(run, int(b.split("=")[1])) for (run,) in runs
             for b in store.children(store.folder("processed_events_log", run_id=run)) if b.split("=")[1].lstrip("-").isdigit()]
    return store.read_log("processed_events_log", LOG_PARTS, parts)


def _update_starts(rows: DataFrame, store: Store, metadata: DataFrame | None) -> tuple[DataFrame, list[tuple]]:
    """Run starts with this batch, and the runs whose known start has changed (an arrival earlier than
    the first one seen, or events per second that have become known)."""
    runs = _values(rows, "run_id")
    eps = store.run_eps([r for (r,) in runs]) if metadata is None else metadata
    old = store.read_partitions("collect_run_starts", RUN_KEYS, runs)
    both = run_starts(rows).drop("eps", "run_start_ms").unionByName(old.drop("run_start_ms"))
    first = arg_extreme(both, RUN_KEYS, [F.col("first_collected_at_ms"), F.coalesce("first_event_id", F.lit(2**63 - 1))],
                        [c for c in both.columns if c not in RUN_KEYS]).select(*both.columns)
    first = aligned(first, eps).drop("eps").persist()
    moved = _values(first.join(old.select("run_id", F.col("run_start_ms").alias("was")), "run_id").where("run_start_ms <> was"), "run_id")
    store.replace_runs("collect_run_starts", first)
    first.unpersist()
    return store.read_partitions("collect_run_starts", RUN_KEYS, runs), moved


def _update_buckets(rows: DataFrame, starts: DataFrame, moved: list, store: Store, cfg: CollectConfig) -> None:
    """Rebuilds the buckets this batch touched from the log of their time blocks; all of a run that moved."""
    width = int(cfg.bucket_seconds * 1000)
    offset = bucket_floor(F.col("collected_at_ms") - F.col("run_start_ms"), width)
    touched = rows.where(F.col("collected_at_ms").isNotNull()).join(starts.select("run_id", "run_start_ms"), "run_id").select(
        "run_id", offset.alias("bucket_offset_ms"), F.col("run_start_ms").alias("s")).distinct().persist()
    begin = F.col("s") + F.col("bucket_offset_ms")
    blocks = _values(touched.select("run_id", F.explode(F.sequence(
        F.floor(begin / LOG_BLOCK_MS).cast("long"), F.floor((begin + width - 1) / LOG_BLOCK_MS).cast("long"))).alias("block")), *LOG_PARTS)
    log = store.read_log("processed_events_log", LOG_PARTS, blocks).select(*RAW_COLUMNS)
    fresh = bucket_rollup(log, starts, cfg.bucket_seconds).join(touched.drop("s"), ["run_id", "bucket_offset_ms"], "left_semi")
    part = F.floor(F.col("bucket_offset_ms") / BUCKETS_PER_PART / width).cast("long")
    fresh = fresh.withColumn("part", part)
    old = store.read_partitions("processed_event_buckets", ["run_id", "part"], _values(touched.select("run_id", part.alias("part")), "run_id", "part"))
    fresh = old.select(*fresh.columns).join(touched, ["run_id", "bucket_offset_ms"], "left_anti").unionByName(fresh)
    if moved:
        rebuilt = bucket_rollup(_whole_log(store, moved).select(*RAW_COLUMNS), starts, cfg.bucket_seconds).withColumn("part", part)
        fresh = fresh.where(~F.col("run_id").isin(*[r for (r,) in moved])).unionByName(rebuilt)
    fresh = fresh.persist()
    fresh.count()  # before any folder it reads goes
    for (run_id,) in moved:  # their old buckets lie at other offsets
        store.drop_run("processed_event_buckets", run_id)
    store.overwrite_parts("processed_event_buckets", fresh, ["run_id", "part"])
    fresh.unpersist()
    touched.unpersist()


def _update_ids(seen: DataFrame, batch_id: int, store: Store) -> DataFrame:
    """Adds a batch's ids to the runs' bitmaps; returns (run_id, distinct_events): how many ids of a run are new.

    A state row holds the bitmap of a range of ids and, for a batch that comes again, the bitmap before its last batch."""
    bucket = F.bitmap_bucket_number("event_id")
    ids = seen.where(F.col("event_id").isNotNull()).select(
        "run_id", F.floor(bucket / BITMAPS_PER_BLOCK).cast("long").alias("id_block"), bucket.alias("bucket"), F.bitmap_bit_position("event_id").alias("bit"))
    keys = ["run_id", "id_block", "bucket"]
    old = store.read_partitions("collect_ids", keys[:2], _values(ids, "run_id", "id_block"))
    base = old.select(*keys, F.when(F.col("upto") < batch_id, F.col("seen")).otherwise(F.col("before")).alias("before"))
    fresh = ids.groupBy(*keys).agg(F.bitmap_construct_agg("bit").alias("seen"))
    state = base.withColumnRenamed("before", "seen").unionByName(fresh).groupBy(*keys).agg(F.bitmap_or_agg("seen").alias("seen"))
    empty = F.lit(bytes(IDS_PER_BITMAP // 8))
    state = state.join(base, keys, "left").select(
        *keys, F.coalesce("before", empty).alias("before"), "seen", F.lit(int(batch_id)).alias("upto")).persist()
    new = state.groupBy("run_id").agg(F.sum(F.bitmap_count("seen") - F.bitmap_count("before")).alias("distinct_events")).persist()
    new.count()
    store.overwrite_parts("collect_ids", state, ["run_id", "id_block"])
    state.unpersist()
    return new


def seen_ids(store: Store, run_ids: list[str]) -> DataFrame:
    """(run_id, event_id) of every id that runs have collected, from their bitmaps; with
    :func:`latencylab.operators.recovery.missing_ranges` the holes."""
    state = store.read_partitions("collect_ids", RUN_KEYS, [(r,) for r in run_ids]).select("run_id", "bucket", "seen")
    byte = state.select("run_id", "bucket", "seen", F.explode(F.sequence(F.lit(0), F.lit(IDS_PER_BITMAP // 8 - 1))).alias("i"))
    byte = byte.select("run_id", "bucket", "i", F.conv(F.hex(F.substring("seen", F.col("i") + 1, F.lit(1))), 16, 10).cast("int").alias("value")).where("value > 0")
    bits = byte.select("run_id", "bucket", (F.col("i") * 8).alias("first"), "value", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    bits = bits.where(F.expr("(value >> bit) & 1 = 1")).select("run_id", "bucket", (F.col("first") + F.col("bit")).cast("long").alias("bit"))
    positive = (F.col("bucket") - 1) * IDS_PER_BITMAP + 1 + F.col("bit")
    return bits.select("run_id", F.when(F.col("bucket") > 0, positive).otherwise(F.col("bucket") * IDS_PER_BITMAP - F.col("bit")).alias("event_id"))


def _update_summaries(rows: DataFrame, starts: DataFrame, batch_id: int, store: Store) -> None:
    """Run summaries from running state: new ids of the touched bitmaps, and latency counts per run.
    Every state row says which batch it includes, so a replayed batch is added once."""
    runs = _values(rows, "run_id")
    seen = rows.where(F.col("collected_at_ms").isNotNull())
    new_counts = _update_ids(seen, batch_id, store)

    latency = seen.where(F.col("latency_ms").isNotNull()).groupBy("run_id", "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    latency = latency.withColumn("upto", F.lit(int(batch_id)))
    old = store.read_partitions("collect_latency", RUN_KEYS, runs)
    done = old.groupBy("run_id").agg(F.max("upto").alias("u")).where(F.col("u") >= batch_id).select("run_id")
    latency = (
        old.select(*latency.columns).unionByName(latency.join(done, "run_id", "left_anti"))
        .groupBy("run_id", "latency_ms").agg(F.sum("n").alias("n"), F.max("upto").alias("upto"))
    )
    store.replace_runs("collect_latency", latency)

    part = seen.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("messages"), F.min("event_id").alias("min_event_id"), F.max("event_id").alias("max_event_id"),
        F.min("collected_at_ms").alias("first_collected_at_ms"), F.max("collected_at_ms").alias("last_collected_at_ms"),
    ).join(new_counts, "run_id", "left").join(run_labels(seen), "run_id").withColumns({
        "distinct_events": F.coalesce("distinct_events", F.lit(0).cast("long")), "upto": F.lit(int(batch_id)),
    })
    old = store.read_partitions("collect_runs", RUN_KEYS, runs)
    done = old.where(F.col("upto") >= batch_id).select("run_id")
    both = old.select(*part.columns).unionByName(part.join(done, "run_id", "left_anti"))
    sums, least, most = ("messages", "distinct_events"), ("min_event_id", "first_collected_at_ms"), ("max_event_id", "last_collected_at_ms", "framework", "scenario", "upto")
    part = both.groupBy("run_id").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most]
    )
    store.replace_runs("collect_runs", part)
    new_counts.unpersist()

    counts = store.read_partitions("collect_latency", RUN_KEYS, runs)
    state = store.read_partitions("collect_runs", RUN_KEYS, runs).join(starts.select("run_id", F.col("run_start_ms").alias("first_sent_at_ms")), "run_id", "left")
    mean = counts.groupBy("run_id").agg((F.sum(F.col("latency_ms") * F.col("n")) / F.sum("n")).alias("avg_latency_ms"), F.max("latency_ms").alias("max_latency_ms"))
    state = state.join(mean, "run_id", "left").join(percentiles(counts, RUN_KEYS, "latency_ms", RANKS, weight="n"), "run_id", "left")
    store.replace_runs("processed_run_summaries", state.select(*SUMMARY_COLUMNS))


def start_collect(stream: DataFrame, store: Store, cfg: CollectConfig, checkpoint: str,
                  trigger: dict | None = None, metadata: DataFrame | None = None, collected_at: str | None = None):
    """Second streaming query: output records -> stored rows and rollups.
    Bounded collection: ``trigger={'availableNow': True}`` with a per-trigger cap
    on the source (``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger``)."""
    if cfg.live_metrics:
        latency = lenient_double(F.get_json_object(F.col("value").cast("string"), "$.latency_ms"))
        observed = observe_latencies(stream.withColumn("latency_ms", latency))
        stream = observed.select(*stream.columns)
    w = stream.writeStream.foreachBatch(
        lambda df, bid: collect_batch(df, bid, store, cfg, metadata, collected_at)
    ).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "1 second"})).start()
