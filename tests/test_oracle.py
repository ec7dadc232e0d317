"""Each registered query against its DuckDB oracle (names, types, rows, values)."""

import pytest

from latencylab.plans.oracle import oracle_sql
from tests.conftest import SF_ORACLE

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    from latencylab.plans.compare import duck_connection

    return duck_connection(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    from latencylab.plans.catalog import queries
    from latencylab.plans.compare import compare

    r = compare(queries()[name](spark, SF_ORACLE), SQL[name], con)
    assert r["ok"], r


def test_every_query_has_an_oracle_or_a_reason():
    from latencylab.plans.catalog import queries

    assert set(queries()) == set(SQL)


def test_double_column_list_is_current(spark):
    from latencylab.plans.gen_doubles import double_columns
    from latencylab.plans.oracle_doubles import DOUBLE_COLUMNS
    from tests.conftest import SF_SMALL

    assert double_columns(spark, SF_SMALL) == DOUBLE_COLUMNS


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert "avg_latency_ci95_low_ms" in df.columns
