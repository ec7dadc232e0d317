"""Keyed running account state with ``applyInPandasWithState`` (SS4 alternative).

One state row per (run, account): count, sum, fraud count, max. Each event gets
the values after it, chunk by chunk as they arrive (by event id inside a chunk), so a task holds
one chunk of a key's rows at a time. Spark partitions, shuffles and checkpoints the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from latencylab.operators.parse import parse_events
from latencylab.operators.rules import STRICT_AGE_RULES, apply_fraud_rules
from latencylab.operators.parse import payload_defaults
from latencylab.operators.running import metric_keys

OUT_SCHEMA = ("run_id string, event_id long, metric_account_id string, account_transaction_count long, "
              "account_total_amount double, account_avg_amount double, account_fraud_count long, "
              "account_max_amount double")
STATE_SCHEMA = "n long, total double, fraud long, mx double"


def _fold(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    n, total, fraud, mx = state.get if state.exists else (0, 0.0, 0, 0.0)
    for pdf in pdfs:
        if pdf.empty:
            continue
        pdf = pdf.sort_values("event_id", kind="stable")
        amount = pdf["TransactionAmount"].fillna(0.0).astype("float64")
        counts = n + pd.Series(range(1, len(pdf) + 1), index=pdf.index, dtype="int64")
        totals = total + amount.cumsum()
        frauds = fraud + pdf["is_fraud"].astype("int64").cumsum()
        maxes = amount.cummax().clip(lower=mx)
        n, total, fraud, mx = int(counts.iloc[-1]), float(totals.iloc[-1]), int(frauds.iloc[-1]), float(maxes.iloc[-1])
        yield pd.DataFrame({
            "run_id": key[0], "event_id": pdf["event_id"].astype("int64"), "metric_account_id": key[1],
            "account_transaction_count": counts, "account_total_amount": totals,
            "account_avg_amount": totals / counts, "account_fraud_count": frauds, "account_max_amount": maxes,
        })
    state.update((n, total, fraud, mx))


def account_state_stream(values: DataFrame, profile=STRICT_AGE_RULES) -> DataFrame:
    """Per-event running account values from a stream of JSON event values."""
    ev = metric_keys(apply_fraud_rules(payload_defaults(parse_events(values, flatten=True)), profile), True)
    ev = ev.select("run_id", "metric_account_id", "event_id", "TransactionAmount", "is_fraud")
    return ev.groupBy("run_id", "metric_account_id").applyInPandasWithState(
        _fold, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )
