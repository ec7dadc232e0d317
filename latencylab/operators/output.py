"""Output record (SNK1): key ``run_id:event_id`` and the nested JSON value.

The record's shape is the declared schema; the value is built by walking it, so another
profile of the record is only another schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from latencylab.schemas import OUTPUT_RECORD

# Flat column of a nested field, by the prefix of the struct it lies in.
PREFIXES = {"result.window_metrics": "window_", "result.account_state": "account_"}
RENAMED = {"result.window_metrics.bucket_start_ms": "window_bucket_ms"}


def source_column(path: str) -> str:
    """Name of the flat column that fills the field at ``path``."""
    parent, _, name = path.rpartition(".")
    return RENAMED.get(path, PREFIXES.get(parent, "") + name)


def nest(schema: StructType, given: dict[str, Column], path: str = "") -> Column:
    """Struct of ``schema`` from flat columns (or the ``given`` ones)."""
    fields = []
    for f in schema:
        at = f"{path}.{f.name}" if path else f.name
        if isinstance(f.dataType, StructType):
            value = nest(f.dataType, given, at)
        else:
            value = given.get(at, F.col(source_column(at)))
        fields.append(value.alias(f.name))
    return F.struct(*fields)


def flatten(schema: StructType, record: str, path: str = "") -> list[Column]:
    """The inverse of :func:`nest`: flat columns of the struct column ``record``."""
    out = []
    for f in schema:
        at = f"{path}.{f.name}" if path else f.name
        if isinstance(f.dataType, StructType):
            out += flatten(f.dataType, record, at)
        else:
            out.append(F.col(f"{record}.{at}").alias(source_column(at)))
    return out


def to_output(df: DataFrame, framework: str = "spark", schema: StructType = OUTPUT_RECORD) -> DataFrame:
    """Key/value string pair for a Kafka-style or file sink."""
    value = nest(schema, {"framework": F.lit(framework)})
    return df.select(F.concat_ws(":", "run_id", "event_id").alias("key"), F.to_json(value).alias("value"))


def from_output(df: DataFrame, schema: StructType = OUTPUT_RECORD) -> DataFrame:
    """Key and all fields of written records as flat columns."""
    parsed = df.select("key", F.from_json("value", schema).alias("r"))
    return parsed.select("key", *flatten(schema, "r"))
