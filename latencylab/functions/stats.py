"""Student-t 95 % confidence interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Two-sided 95 % Student-t critical values by degrees of freedom 1..30;
# above 30 degrees of freedom the normal value 1.96 is used.
T_CRITICAL_95 = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306,
    9: 2.262, 10: 2.228, 11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131,
    16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086, 21: 2.080, 22: 2.074,
    23: 2.069, 24: 2.064, 25: 2.060, 26: 2.056, 27: 2.052, 28: 2.048, 29: 2.045,
    30: 2.042,
}
T_NORMAL_95 = 1.96


def t_critical_col(n):
    """t critical value for a sample count column, as a CASE expression (no join)."""
    n = F.col(n) if isinstance(n, str) else n
    dof = n - 1
    expr = F.when(n.isNull() | (n < 2), F.lit(None).cast("double"))
    for k, v in sorted(T_CRITICAL_95.items()):
        expr = expr.when(dof == k, F.lit(v))
    return expr.otherwise(F.lit(T_NORMAL_95))


def with_ci95(df: DataFrame, mean: str, stddev: str, n: str, prefix: str) -> DataFrame:
    """Add ``{prefix}_ci95_low_ms``, ``_high_ms``, ``_margin_ms``; null when n < 2."""
    t = t_critical_col(n)
    ok = F.col(mean).isNotNull() & F.col(stddev).isNotNull() & F.col(n).isNotNull() & (F.col(n) >= 2)
    margin = F.when(ok, t * (F.col(stddev).cast("double") / F.sqrt(F.col(n).cast("double"))))
    return df.withColumns({
        f"{prefix}_ci95_margin_ms": margin,
        f"{prefix}_ci95_low_ms": F.col(mean) - margin,
        f"{prefix}_ci95_high_ms": F.col(mean) + margin,
    })
