"""File sources (SRC1, SRC3-SRC6): JSONL logs, CSV inputs, stored raw events.

All readers declare their schema (no inference) and return lazy DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from latencylab.operators.parse import as_text, clean_nan, lenient
from latencylab.schemas import COLLECTED_RECORD, FAULT_LOG, PAYLOAD, PROCESSED_EVENTS, SCENARIOS


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str | None, schema: StructType) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped; an absent path
    gives an empty DataFrame (a run without a fault log)."""
    if not path or not _exists(spark, path):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path).where(F.trim(F.col("value")) != "")
    return text.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_fault_log(spark: SparkSession, path: str | None) -> DataFrame:
    return read_jsonl(spark, path, FAULT_LOG)


def read_transactions_csv(spark: SparkSession, path: str, schema: StructType = PAYLOAD) -> DataFrame:
    """Transaction CSV with a header and declared columns; NaN becomes null."""
    df = spark.read.option("header", "true").option("nanValue", "NaN").schema(schema).csv(path)
    return clean_nan(df)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario table ``scenario, eps, duration``."""
    return spark.read.option("header", "true").schema(SCENARIOS).csv(path)


def scenario_volume(scenarios: DataFrame, scenario: str | None = None) -> DataFrame:
    """Expected events per scenario, the whole part of ``eps * duration``; optionally one scenario."""
    out = scenarios.withColumn("expected_events", (F.col("eps") * F.col("duration")).cast("long"))
    return out if scenario is None else out.where(F.col("scenario") == scenario)


def read_run_events(spark: SparkSession, jsonl_path: str | None, table: DataFrame | None,
                    run_id: str | None = None, schema: StructType | None = None) -> DataFrame:
    """A run's raw events with the columns of the stored table: the JSONL log when present, else the
    stored table; optionally one run, in arrival order (time, then id)."""
    if jsonl_path and _exists(spark, jsonl_path):
        text = read_jsonl(spark, jsonl_path, as_text(schema or COLLECTED_RECORD))
        df = text.select(*[lenient(f.name, f.dataType, F.col(f.name)) for f in PROCESSED_EVENTS])
    elif table is not None:
        df = table.select(*PROCESSED_EVENTS.names)
    else:
        df = spark.createDataFrame([], PROCESSED_EVENTS)
    df = df if run_id is None else df.where(F.col("run_id") == run_id)
    return df.orderBy("run_id", F.col("collected_at_ms").asc_nulls_first(), "event_id")
