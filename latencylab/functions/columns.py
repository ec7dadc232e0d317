"""Column-level helpers. All are built-in Spark expressions (codegen, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket_floor(c, width_ms) -> Column:
    """Start of the fixed-width bucket holding ``c``: floors negatives too."""
    x = _c(c)
    w = F.lit(width_ms) if not isinstance(width_ms, Column) else width_ms
    return x - F.pmod(x, w)


def epoch_ms_ntz(c) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ column, independent of the session zone."""
    return F.expr(
        f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c}) div 1000"
    )


def lenient_double(c) -> Column:
    """Lenient numeric read: anything not castable becomes null."""
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")


def effective_ts(collected="collected_at_ms", processed="processed_at_ms") -> Column:
    """Collected time, else processed time; 0 counts as missing."""
    return F.coalesce(F.nullif(_c(collected), F.lit(0)), _c(processed))


def unknown_if_null(c, empty_is_null: bool = False) -> Column:
    x = _c(c)
    if empty_is_null:
        x = F.nullif(x, F.lit(""))
    return F.coalesce(x, F.lit("unknown"))


def parse_run_id(c="run_id") -> Column:
    """framework_scenario_iteration, split from the right: the middle may hold '_'."""
    x = _c(c)
    pat = r"^([^_]+)_(.+)_([^_]+)$"
    ok = x.rlike(pat)
    return F.struct(
        F.when(ok, F.regexp_extract(x, pat, 1)).alias("framework"),
        F.when(ok, F.regexp_extract(x, pat, 2)).alias("scenario"),
        F.when(ok, F.regexp_extract(x, pat, 3)).alias("iteration"),
    )


def split_iteration(c="run_id") -> Column:
    """Third '_' part of a run id (empty when absent), as SQL split_part does."""
    return F.expr(f"split_part({c}, '_', 3)") if isinstance(c, str) else F.split_part(c, F.lit("_"), F.lit(3))


def rescale_metric_latency(c="latency_ms") -> Column:
    """Live-metric rescale: values above 60 s are taken as nanoseconds."""
    x = _c(c)
    return F.when(x > 60000, F.floor(x / F.lit(1_000_000)).cast("double")).otherwise(x)
