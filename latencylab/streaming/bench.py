"""Streaming throughput and micro-batch time of the enrichment pipeline over a file stream."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

from latencylab.operators.parse import envelope_json
from latencylab.session import scratch_path
from latencylab.streaming.pipeline import PipelineConfig, read_events_stream, start_pipeline


def _run(spark: SparkSession, events, files: int, per_trigger: int) -> tuple[float, list[float]]:
    """Seconds of the whole query and of each micro-batch that had rows."""
    root = scratch_path(spark, f"stream-bench-{int(time.time() * 1000)}")
    envelope_json(events).select("value").repartition(files).write.mode("overwrite").text(f"{root}/in")
    stream = read_events_stream(spark, "files", f"{root}/in", {"maxFilesPerTrigger": str(per_trigger)})
    t0 = time.time()
    q = start_pipeline(stream, PipelineConfig(output_dir=f"{root}/out"), f"{root}/ckpt", {"availableNow": True})
    q.awaitTermination()
    batches = [p["durationMs"]["triggerExecution"] / 1000 for p in q.recentProgress if p["numInputRows"]]
    return time.time() - t0, batches


def stream_throughput(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Events per second over all events in large batches, and the median time of a batch of 400 events
    (the offered load of one second) after the first."""
    from latencylab.plans.catalog import tables

    tx = tables(spark, sf_dir).transactions
    seconds, _ = _run(spark, tx, 8, 2)
    _, batches = _run(spark, tx.limit(400 * 8), 8, 1)
    later = sorted(batches[1:]) or batches
    return {"stream_events_per_sec": round(tx.count() / seconds, 1), "stream_400_event_batch_seconds": round(later[len(later) // 2], 2)}
