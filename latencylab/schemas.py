"""Declared schemas: event envelope, output record, stored tables, logs."""

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

PAYLOAD_FIELDS = [
    ("TransactionID", StringType()),
    ("AccountID", StringType()),
    ("TransactionAmount", DoubleType()),
    ("TransactionType", StringType()),
    ("Channel", StringType()),
    ("CustomerAge", LongType()),
    ("LoginAttempts", LongType()),
    ("AccountBalance", DoubleType()),
    ("MerchantID", StringType()),
]
PAYLOAD_NAMES = [n for n, _ in PAYLOAD_FIELDS]

PAYLOAD = StructType([StructField(n, t) for n, t in PAYLOAD_FIELDS])

ENVELOPE = StructType(
    [
        StructField("run_id", StringType()),
        StructField("event_id", LongType()),
        StructField("sent_at_ms", LongType()),
        StructField("scenario", StringType()),
        StructField("payload", PAYLOAD),
    ]
)

WINDOW_METRICS = StructType(
    [
        StructField("bucket_start_ms", LongType()),
        StructField("transaction_count", LongType()),
        StructField("total_amount", DoubleType()),
        StructField("avg_amount", DoubleType()),
        StructField("fraud_count", LongType()),
    ]
)
ACCOUNT_STATE = StructType(
    [
        StructField("transaction_count", LongType()),
        StructField("total_amount", DoubleType()),
        StructField("avg_amount", DoubleType()),
        StructField("fraud_count", LongType()),
    ]
)
RESULT = StructType(
    [StructField(n, t) for n, t in PAYLOAD_FIELDS]
    + [
        StructField("is_fraud", BooleanType()),
        StructField("window_metrics", WINDOW_METRICS),
        StructField("account_state", ACCOUNT_STATE),
    ]
)
OUTPUT_RECORD = StructType(
    [
        StructField("framework", StringType()),
        StructField("run_id", StringType()),
        StructField("event_id", LongType()),
        StructField("sent_at_ms", LongType()),
        StructField("processed_at_ms", LongType()),
        StructField("latency_ms", LongType()),
        StructField("scenario", StringType()),
        StructField("result", RESULT),
    ]
)
# The per-record profile also reports the account's largest amount so far.
EVENT_OUTPUT_RECORD = StructType([
    f if f.name != "result" else StructField("result", StructType([
        g if g.name != "account_state" else StructField("account_state", StructType([*ACCOUNT_STATE.fields, StructField("max_amount", DoubleType())]))
        for g in RESULT
    ]))
    for f in OUTPUT_RECORD
])
# Collected record: the output record plus the arrival stamp.
COLLECTED_RECORD = StructType(OUTPUT_RECORD.fields + [StructField("collected_at_ms", LongType())])

FAULT_LOG = StructType(
    [
        StructField("run_id", StringType()),
        StructField("service", StringType()),
        StructField("container", StringType()),
        StructField("action", StringType()),
        StructField("phase", StringType()),
        StructField("timestamp_ms", LongType()),
        StructField("delay_seconds", IntegerType()),
        StructField("duration_seconds", IntegerType()),
        StructField("count", IntegerType()),
    ]
)

SCENARIOS = StructType(
    [
        StructField("scenario", StringType()),
        StructField("eps", DoubleType()),
        StructField("duration", DoubleType()),
    ]
)

PROCESSED_EVENTS = StructType(
    [
        StructField("run_id", StringType()),
        StructField("framework", StringType()),
        StructField("scenario", StringType()),
        StructField("event_id", LongType()),
        StructField("sent_at_ms", LongType()),
        StructField("processed_at_ms", LongType()),
        StructField("collected_at_ms", LongType()),
        StructField("latency_ms", DoubleType()),
    ]
)

METRIC_SAMPLES = StructType(
    [
        StructField("run_id", StringType()),
        StructField("id", StringType()),
        StructField("timestamp_ms", LongType()),
        StructField("value", DoubleType()),
    ]
)
