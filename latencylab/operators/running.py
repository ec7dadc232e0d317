"""Per-account and per-window metrics: totals, running per-event values and
batch-end cumulative values (AG1-AG3, WN1-WN3, JN1-JN2, PRJ8).

All state is additive (count, sum, fraud count) or a maximum, so the per-event
running values are blocked prefix scans (see ``scan``) and the batch-end values
are the same scans with a RANGE frame on the batch id: every row of a batch sees
the total after the whole batch, which is what a micro-batch sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latencylab.functions.columns import bucket_floor, unknown_if_null
from latencylab.operators.rules import WINDOW_SIZE_MS
from latencylab.operators.scan import running_totals

ACCOUNT_KEYS = ["run_id", "metric_account_id"]
WINDOW_KEYS = ["run_id", "metric_scenario", "window_bucket_ms", "metric_channel", "metric_transaction_type"]


def metric_keys(df: DataFrame, empty_is_unknown: bool = False, flat: bool = True) -> DataFrame:
    """Dimension keys with null (and optionally empty) mapped to ``unknown``."""
    p = "" if flat else "payload."
    cols = {
        "metric_account_id": unknown_if_null(F.col(f"{p}AccountID"), empty_is_unknown),
        "metric_channel": unknown_if_null(F.col(f"{p}Channel"), empty_is_unknown),
        "metric_transaction_type": unknown_if_null(F.col(f"{p}TransactionType"), empty_is_unknown),
        "metric_scenario": unknown_if_null(F.col("scenario"), empty_is_unknown),
    }
    if "window_bucket_ms" not in df.columns:
        cols["window_bucket_ms"] = bucket_floor("sent_at_ms", WINDOW_SIZE_MS)
    return df.withColumns(cols)


def _fraud_int() -> Column:
    return F.when(F.col("is_fraud"), 1).otherwise(0).cast("long")


def account_metrics(df: DataFrame, amount: str = "TransactionAmount") -> DataFrame:
    """Totals per (run, account): count, sum (nulls add 0), avg = sum / count, fraud
    count, and max amount floored at 0."""
    keyed = metric_keys(df)
    agg = keyed.groupBy(*ACCOUNT_KEYS).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_amount"),
        F.sum(_fraud_int()).alias("fraud_count"),
        F.greatest(F.lit(0.0), F.coalesce(F.max(amount), F.lit(0.0))).alias("max_amount"),
    )
    return agg.withColumn("avg_amount", F.col("total_amount") / F.col("transaction_count"))


def window_metrics(df: DataFrame, amount: str = "TransactionAmount") -> DataFrame:
    """Totals per (run, scenario, 30-s bucket, channel, type)."""
    keyed = metric_keys(df)
    agg = keyed.groupBy(*WINDOW_KEYS).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_amount"),
        F.sum(_fraud_int()).alias("fraud_count"),
    )
    return agg.withColumn("avg_amount", F.col("total_amount") / F.col("transaction_count"))


def _running(df, keys, order, amount, peers, with_max, prefix):
    sums = {
        f"{prefix}transaction_count": F.lit(1).cast("long"),
        f"{prefix}total_amount": F.coalesce(F.col(amount).cast("double"), F.lit(0.0)),
        f"{prefix}fraud_count": _fraud_int(),
    }
    maxes = {f"{prefix}max_amount": F.coalesce(F.col(amount).cast("double"), F.lit(0.0))} if with_max else {}
    out = running_totals(df, keys, [order], sums=sums, maxes=maxes, peers=peers)
    if with_max:
        out = out.withColumn(f"{prefix}max_amount", F.greatest(F.lit(0.0), F.col(f"{prefix}max_amount")))
    return out.withColumn(
        f"{prefix}avg_amount", F.col(f"{prefix}total_amount") / F.col(f"{prefix}transaction_count")
    )


def account_running(df: DataFrame, amount: str = "TransactionAmount", order: str = "event_id",
                    prefix: str = "account_", empty_is_unknown: bool = False) -> DataFrame:
    """Per-event running account values in event order (one value per event)."""
    keyed = metric_keys(df, empty_is_unknown)
    return _running(keyed, ACCOUNT_KEYS, order, amount, False, True, prefix)


def window_running(df: DataFrame, amount: str = "TransactionAmount", order: str = "event_id",
                   prefix: str = "window_", empty_is_unknown: bool = False) -> DataFrame:
    """Per-event running values of the event's 30-s window key."""
    keyed = metric_keys(df, empty_is_unknown)
    return _running(keyed, WINDOW_KEYS, order, amount, False, False, prefix)


def account_batch_cumulative(df: DataFrame, amount: str = "TransactionAmount", batch: str = "batch_id",
                             prefix: str = "account_", empty_is_unknown: bool = False) -> DataFrame:
    """Batch-end cumulative account values: all rows of a batch share them."""
    return _running(metric_keys(df, empty_is_unknown), ACCOUNT_KEYS, batch, amount, True, False, prefix)


def window_batch_cumulative(df: DataFrame, amount: str = "TransactionAmount", batch: str = "batch_id",
                            prefix: str = "window_", empty_is_unknown: bool = False) -> DataFrame:
    return _running(metric_keys(df, empty_is_unknown), WINDOW_KEYS, batch, amount, True, False, prefix)


def add_running_metrics(df: DataFrame, grain: str = "batch", amount: str = "TransactionAmount",
                        batch: str = "batch_id", order: str = "event_id", empty_is_unknown: bool = False) -> DataFrame:
    """Both metric families on each event: ``grain='batch'`` gives batch-end values
    (the micro-batch job), ``grain='event'`` per-event values (the per-record job).

    Every event stays, also one without a send time (its window bucket is null, a
    key value of its own) or with a null scenario.
    """
    if grain == "batch":
        out = window_batch_cumulative(df, amount, batch, empty_is_unknown=empty_is_unknown)
        return account_batch_cumulative(out, amount, batch, empty_is_unknown=empty_is_unknown)
    if grain == "event":
        out = window_running(df, amount, order, empty_is_unknown=empty_is_unknown)
        return account_running(out, amount, order, empty_is_unknown=empty_is_unknown)
    raise ValueError("grain must be 'batch' or 'event'")
