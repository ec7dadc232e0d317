"""Physical-plan checks: filters and columns reach the scan, no cartesian
products, no Python UDFs in batch plans."""

import pytest

from tests.conftest import SF_SMALL

BAD_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


RAW = ("events.parquet", "processed_events", "fx_kept", "fx_seq", "transactions")


_PLANS = {}


def _query_plan(spark, name):
    """Plan of a registered query, made once for all checks."""
    from latencylab.plans.catalog import queries

    if name not in _PLANS:
        _PLANS[name] = _plan(queries()[name](spark, SF_SMALL))
    return _PLANS[name]


def _names():
    from latencylab.plans.catalog import queries

    return sorted(queries())


@pytest.mark.parametrize("name", _names())
def test_no_cartesian_or_python_udf(spark, name):
    plan = _query_plan(spark, name)
    for node in BAD_NODES:
        assert node not in plan, f"{name}: {node}"


def test_run_filter_reaches_the_scan(spark):
    from latencylab.operators.runs import keep_run
    from latencylab.plans.catalog import tables

    df = keep_run(tables(spark, SF_SMALL).processed_events_all, "spark_low_01")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(run_id), EqualTo(run_id,spark_low_01)]" in plan


def test_projection_is_pruned_at_the_scan(spark):
    from latencylab.plans.catalog import queries

    plan = _plan(queries()["fraud_rules"](spark, SF_SMALL))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "MerchantID" not in scan and "AccountBalance" not in scan


def test_window_scans_are_blocked(spark):
    """Per-run ordered scans partition by (run, block), never by the run alone."""
    from latencylab.plans.catalog import queries

    plan = _plan(queries()["gap_series"](spark, SF_SMALL))
    assert "_blk" in plan


@pytest.mark.parametrize("name", _names())
def test_no_sort_aggregate_or_percentile_buffer_over_raw_rows(spark, name):
    """Aggregates whose input is a scan of raw rows are hash aggregates with fixed-width buffers."""
    plan = _query_plan(spark, name).splitlines()
    for i, line in enumerate(plan):
        assert not any(f in line for f in ("percentile(", "percentile_cont", "percentile_disc", "median("))
        if "SortAggregate" not in line:
            continue
        below = []
        for x in plan[i + 1 :]:
            below.append(x)
            if any(n in x for n in ("HashAggregate", "Join", "Scan")):  # counted rows, or the ties of a join
                break
        assert "Scan" not in below[-1] or not any(r in below[-1] for r in RAW), (name, below[-1])


def test_fault_attempts_meet_records_by_equi_join(spark):
    from latencylab.plans.catalog import queries

    df = queries()["fault_attempt_sections"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
