"""Structured Streaming pipeline: events in, enriched records out (SS1-SS7, SS11).

``start_pipeline`` reads JSON event values (a Kafka topic, or a folder of text files),
parses them, applies the fraud rules, adds the running account and window metrics, and writes
key/value output.

Running state is in Spark's own state store. ``grain="batch"`` gives all rows of a micro-batch the totals
after it: a streaming aggregate keeps them per account and per window (combined per task before the shuffle, no Python
worker), its rows of the keys that a batch touched arrive together with the batch's events, and are joined to them there.
``grain="event"`` gives the running value at each event in arrival order: every event is sent to its account's and
its window's key, one stateful operator folds each key's rows chunk by chunk, and within the micro-batch the
two rows of an event are joined again. State and offsets are in the query's checkpoint; files of a batch
replace those of a replayed one, so file output neither loses nor repeats records (a Kafka sink
may receive a replayed batch again).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from latencylab.operators.output import flatten, to_output
from latencylab.operators.parse import latency_enrich, parse_events, parse_events_lenient
from latencylab.operators.rules import DEFAULT_RULES, RuleProfile, apply_fraud_rules
from latencylab.operators.running import ACCOUNT_KEYS, WINDOW_KEYS, metric_keys
from latencylab.schemas import EVENT_OUTPUT_RECORD, OUTPUT_RECORD

FAMILIES = {"account": ACCOUNT_KEYS, "window": WINDOW_KEYS}
TOTALS = ("transaction_count", "total_amount", "fraud_count", "max_amount")
STATE = "transaction_count long, total_amount double, fraud_count long, max_amount double"
FOLDED = f"family string, state_key string, uid string, record string, {STATE}"


@dataclass
class PipelineConfig:
    output_dir: str
    framework: str = "spark"
    profile: RuleProfile = DEFAULT_RULES
    grain: str = "batch"  # "batch": batch-end values; "event": per-event running values
    per_record: bool = False  # lenient numbers, empty names unknown, the account's largest amount in the output
    output_format: str = "json"  # json files of key/value, or "kafka" with kafka_options
    kafka_options: dict | None = None

    @property
    def schema(self):
        return EVENT_OUTPUT_RECORD if self.per_record else OUTPUT_RECORD


def kafka_source_options(options: dict | None = None, starting_offsets: str = "latest") -> dict[str, str]:
    """Options of the topic reader: where to start, and lost offsets tolerated."""
    return {"startingOffsets": starting_offsets, "failOnDataLoss": "false", **(options or {})}


def read_events_stream(spark: SparkSession, source: str = "files", path: str | None = None,
                       options: dict | None = None, starting_offsets: str = "latest") -> DataFrame:
    """The input stream as a ``value`` column of JSON text.

    ``source='kafka'`` subscribes with :func:`kafka_source_options`; ``source='files'`` reads new text
    files of a folder (one JSON event per line)."""
    if source == "kafka":
        reader = spark.readStream.format("kafka").options(**kafka_source_options(options, starting_offsets))
        return reader.load().select(F.col("value").cast("string").alias("value"))
    return spark.readStream.format("text").options(**(options or {})).load(path)


def enriched(values: DataFrame, cfg: PipelineConfig, processed_at: str | None = None) -> DataFrame:
    """Parsed, stamped and judged events with their metric keys."""
    ev = parse_events_lenient(values) if cfg.per_record else parse_events(values, flatten=True)
    ev = apply_fraud_rules(latency_enrich(ev, processed_at=processed_at), cfg.profile)
    return metric_keys(ev, empty_is_unknown=cfg.per_record)


def _fold(key, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Folds one key's rows into its state, a chunk at a time; every row gets the values after it."""
    n, total, fraud, top = state.get if state.exists else (0, 0.0, 0, 0.0)
    for pdf in chunks:
        if pdf.empty:
            continue
        amount = pdf["amount"].astype("float64")
        counts = n + pd.Series(range(1, len(pdf) + 1), index=pdf.index, dtype="int64")
        totals = total + amount.cumsum()
        frauds = fraud + pdf["fraud"].astype("int64").cumsum()
        tops = amount.cummax().clip(lower=top)
        n, total, fraud, top = int(counts.iloc[-1]), float(totals.iloc[-1]), int(frauds.iloc[-1]), float(tops.iloc[-1])
        yield pd.DataFrame({"family": key[0], "state_key": key[1], "uid": pdf["uid"], "record": pdf["record"], **dict(zip(TOTALS, (counts, totals, frauds, tops)))})
    state.update((n, total, fraud, top))


def _keyed(events: DataFrame) -> DataFrame:
    """(record, amount, fraud, account, window): an event as JSON and the keys of its two families as JSON."""
    return events.select(
        F.to_json(F.struct(*events.columns)).alias("record"), F.coalesce("TransactionAmount", F.lit(0.0)).cast("double").alias("amount"),
        F.when(F.col("is_fraud"), 1).otherwise(0).cast("long").alias("fraud"),
        *[F.to_json(F.struct(*keys)).alias(family) for family, keys in FAMILIES.items()],
    )


def stateful_rows(events: DataFrame, grain: str) -> DataFrame:
    """Event grain: two rows of the stateful operator per event (the account's carries the event itself). Batch grain: one row per
    event, and one per key that the batch touched with the key's totals after the batch."""
    if grain not in ("batch", "event"):
        raise ValueError("grain must be 'batch' or 'event'")
    keyed = _keyed(events)
    if grain == "batch":
        keys = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("state_key")) for f in FAMILIES])).alias("k")
        totals = keyed.select("amount", "fraud", keys).groupBy("k.family", "k.state_key").agg(
            F.count(F.lit(1)).alias("transaction_count"), F.sum("amount").alias("total_amount"), F.sum("fraud").alias("fraud_count"),
            F.greatest(F.lit(0.0), F.max("amount")).alias("max_amount"),
        )
        return keyed.select("record", *FAMILIES).unionByName(totals, allowMissingColumns=True)
    keys = F.array(*[
        F.struct(F.lit(f).alias("family"), F.col(f).alias("state_key"), (F.col("record") if f == "account" else F.lit(None)).alias("record"))
        for f in FAMILIES
    ])
    rows = keyed.withColumn("uid", F.uuid()).select("uid", "amount", "fraud", F.explode(keys).alias("k")).select("k.family", "k.state_key", "k.record", "uid", "amount", "fraud")
    return rows.groupBy("family", "state_key").applyInPandasWithState(_fold, FOLDED, STATE, "update", GroupStateTimeout.NoTimeout)


def recombine(rows: DataFrame, grain: str, record_schema) -> DataFrame:
    """One row per event with both families' metrics, from the stateful rows of a micro-batch."""
    if grain == "batch":
        both = rows.where("record is not null").select("record", *FAMILIES)
        for f in FAMILIES:
            totals = rows.where(F.col("family") == f).select(F.col("state_key").alias(f), *[F.col(c).alias(f"{f}_{c}") for c in TOTALS])
            both = both.join(totals, f)
    else:
        named = {f: rows.where(F.col("family") == f).select("uid", "record", *[F.col(c).alias(f"{f}_{c}") for c in TOTALS]) for f in FAMILIES}
        both = named["account"].join(named["window"].drop("record"), "uid")
    out = both.withColumn("r", F.from_json("record", record_schema)).select("r.*", *[f"{f}_{c}" for f in FAMILIES for c in TOTALS])
    return out.withColumns({f"{f}_avg_amount": F.col(f"{f}_total_amount") / F.col(f"{f}_transaction_count") for f in FAMILIES})


def write_batch(rows: DataFrame, batch_id: int, cfg: PipelineConfig, record_schema) -> None:
    """Output of one micro-batch; a replayed batch replaces its files."""
    rows = rows.persist()
    try:
        result = to_output(recombine(rows, cfg.grain, record_schema), cfg.framework, cfg.schema)
        if cfg.output_format == "kafka":
            result.write.format("kafka").options(**(cfg.kafka_options or {})).save()
        else:
            (result.withColumn("batch_id", F.lit(int(batch_id)))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").json(cfg.output_dir))
    finally:
        rows.unpersist()


def start_pipeline(stream: DataFrame, cfg: PipelineConfig, checkpoint: str, trigger: dict | None = None,
                   processed_at: str | None = None):
    """Start the streaming query (``trigger`` e.g. ``{"processingTime": "1 second"}``
    or ``{"availableNow": True}``)."""
    events = enriched(stream, cfg, processed_at)
    schema = events.schema
    w = (
        stateful_rows(events, cfg.grain).writeStream.outputMode("update")
        .foreachBatch(lambda rows, bid: write_batch(rows, bid, cfg, schema))
        .option("checkpointLocation", checkpoint)
    )
    return w.trigger(**(trigger or {"processingTime": "1 second"})).start()


def read_output(spark: SparkSession, output_dir: str, schema=OUTPUT_RECORD) -> DataFrame:
    """Decode the written output back to flat columns (for checks and the collector)."""
    raw = spark.read.schema("key string, value string, batch_id long").json(output_dir)
    rec = raw.select(F.from_json("value", schema).alias("r"), "batch_id")
    return rec.select(*flatten(schema, "r"), "batch_id")
