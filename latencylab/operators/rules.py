"""Declarative fraud rules (PRJ3-PRJ6) and the 30-s window bucket (PRJ7)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.functions.columns import bucket_floor

WINDOW_SIZE_MS = 30_000


@dataclass(frozen=True)
class RuleProfile:
    """Rule thresholds. The default matches the Spark job; ``STRICT_AGE`` the Flink job."""

    amount_limit: float = 10000.0
    age_limit: int = 70
    login_limit: int = 3
    debit_type: str = "Debit"
    remote_channels: tuple = ("Online", "Mobile")
    mobile_channel: str = "Mobile"


DEFAULT_RULES = RuleProfile()
STRICT_AGE_RULES = RuleProfile(age_limit=80)


def apply_fraud_rules(df: DataFrame, profile: RuleProfile = DEFAULT_RULES, flat: bool = True) -> DataFrame:
    """Add the three rule flags and ``is_fraud`` (any rule; unknown counts as false).

    ``flat`` selects payload columns at top level; otherwise under ``payload.``.
    """
    p = "" if flat else "payload."
    amount, ttype, channel = F.col(f"{p}TransactionAmount"), F.col(f"{p}TransactionType"), F.col(f"{p}Channel")
    age, logins = F.col(f"{p}CustomerAge"), F.col(f"{p}LoginAttempts")
    high_amount = amount > F.lit(profile.amount_limit)
    channel_mismatch = (ttype == F.lit(profile.debit_type)) & channel.isin(*profile.remote_channels)
    age_anomaly = (age > F.lit(profile.age_limit)) & ((channel == F.lit(profile.mobile_channel)) | (logins > F.lit(profile.login_limit)))
    return df.withColumns({
        "is_high_amount": F.coalesce(high_amount, F.lit(False)),
        "is_channel_mismatch": F.coalesce(channel_mismatch, F.lit(False)),
        "is_age_anomaly": F.coalesce(age_anomaly, F.lit(False)),
        "is_fraud": F.when(high_amount | channel_mismatch | age_anomaly, True).otherwise(False),
    })


def with_bucket(df: DataFrame, width_ms: int = WINDOW_SIZE_MS, ts: str = "sent_at_ms", name: str = "window_bucket_ms") -> DataFrame:
    """Tumbling bucket start of the event time (null when the time is null)."""
    return df.withColumn(name, bucket_floor(ts, width_ms))
