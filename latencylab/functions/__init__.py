from latencylab.functions.columns import (  # noqa: F401
    bucket_floor,
    effective_ts,
    epoch_ms_ntz,
    lenient_double,
    parse_run_id,
    split_iteration,
    rescale_metric_latency,
    unknown_if_null,
)
from latencylab.functions.stats import T_CRITICAL_95, with_ci95  # noqa: F401
