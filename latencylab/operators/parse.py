"""Event decoding and payload projections (SRC2, PRJ1, PRJ2, PRJ9, PRJ11, PRJ14, PRJ16, SRC4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from latencylab.operators.scan import sequence_number
from latencylab.schemas import ENVELOPE, PAYLOAD_NAMES


def parse_events(df: DataFrame, value_col: str = "value", flatten: bool = False) -> DataFrame:
    """Decode JSON event values against the declared envelope; drop rows lacking
    ``run_id`` or ``event_id`` (malformed JSON decodes to nulls and falls out here)."""
    parsed = df.select(F.from_json(F.col(value_col).cast("string"), ENVELOPE).alias("event")).select("event.*")
    parsed = parsed.where(F.col("run_id").isNotNull() & F.col("event_id").isNotNull())
    if flatten:
        parsed = parsed.select(
            "run_id", "event_id", "sent_at_ms", "scenario", *[F.col(f"payload.{n}").alias(n) for n in PAYLOAD_NAMES]
        )
    return parsed


def latency_enrich(df: DataFrame, processed_at=None) -> DataFrame:
    """Stamp ``processed_at_ms`` (now, once per micro-batch, unless a column is given)
    and ``latency_ms = processed_at_ms - sent_at_ms`` (null when sent is null)."""
    stamp = F.expr("unix_millis(current_timestamp())") if processed_at is None else F.col(processed_at)
    return df.withColumn("processed_at_ms", stamp).withColumn(
        "latency_ms", F.col("processed_at_ms") - F.col("sent_at_ms")
    )


def parse_events_lenient(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Flat events of the per-record profile: numbers may come as text or with a fraction.

    The envelope is read as text and cast leniently, so ``"85"`` and ``85`` are the same age;
    rows lacking ``run_id`` or a readable ``event_id`` are dropped, and rule inputs that cannot be read take
    their defaults (:func:`payload_defaults`)."""
    text = df.select(F.from_json(F.col(value_col).cast("string"), as_text(ENVELOPE)).alias("event")).select("event.*")
    flat = text.select(
        "run_id", lenient_long("event_id"), lenient_long("sent_at_ms"), "scenario",
        *[lenient(f.name, f.dataType, F.col(f"payload.{f.name}")) for f in ENVELOPE["payload"].dataType],
    ).where(F.col("run_id").isNotNull() & F.col("event_id").isNotNull())
    return payload_defaults(flat)


def as_text(schema: StructType) -> StructType:
    """The same nesting with every leaf read as text."""
    return StructType([
        StructField(f.name, as_text(f.dataType) if isinstance(f.dataType, StructType) else StringType()) for f in schema
    ])


def lenient_long(name: str, c: Column | None = None) -> Column:
    """Whole number from text; a fraction is cut off, anything else unreadable is null."""
    x = F.col(name) if c is None else c
    return F.coalesce(x.try_cast("long"), x.try_cast("double").try_cast("long")).alias(name)


def lenient(name: str, kind: DataType, c: Column) -> Column:
    """A text column read as ``kind`` where it can be."""
    if isinstance(kind, LongType):
        return lenient_long(name, c)
    return (c if isinstance(kind, StringType) else c.try_cast(kind)).alias(name)


def payload_defaults(df: DataFrame) -> DataFrame:
    """Lenient profile: missing or non-numeric rule inputs take defaults
    ('' for text, 0 for numbers) so the rules never see nulls."""
    return df.withColumns({
        "AccountID": F.coalesce(F.col("AccountID").cast("string"), F.lit("")),
        "TransactionAmount": F.coalesce(F.col("TransactionAmount").try_cast("double"), F.lit(0.0)),
        "TransactionType": F.coalesce(F.col("TransactionType").cast("string"), F.lit("")),
        "Channel": F.coalesce(F.col("Channel").cast("string"), F.lit("")),
        "CustomerAge": F.coalesce(F.col("CustomerAge").try_cast("long"), F.lit(0).cast("long")),
        "LoginAttempts": F.coalesce(F.col("LoginAttempts").try_cast("long"), F.lit(0).cast("long")),
    })


def event_envelope(df: DataFrame) -> DataFrame:
    """Wrap payload columns into the event envelope; key = event id as text."""
    return df.select(
        F.col("event_id").cast("string").alias("key"),
        F.struct(
            "run_id", "event_id", "sent_at_ms", "scenario", F.struct(*[F.col(n) for n in PAYLOAD_NAMES]).alias("payload")
        ).alias("event"),
    )


def envelope_json(df: DataFrame) -> DataFrame:
    """Envelope as a key/value pair of strings, as published on the input topic."""
    env = event_envelope(df)
    return env.select("key", F.to_json("event").alias("value"))


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN in any floating column becomes null (the CSV loader's NaN -> None)."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out = out.withColumn(f.name, F.when(~F.isnan(F.col(f.name)), F.col(f.name)))
    return out


def replay_sample(source: DataFrame, order_col: str, n_events=None, seed: int = 42) -> DataFrame:
    """Bounded replay: ``n_events`` draws with replacement from the source rows.

    Draw ``i`` (0-based) picks source row ``h(i) mod n``, h the first 15 hexadecimal digits of
    md5("seed:i"): independent draws, so some rows repeat and others are missed. Event ids
    are ``i + 1``. Source rows are numbered by an exact skew-safe sequence over
    ``order_col``. Without ``n_events`` the replay has as many events as source
    rows, and the draw index is the source row index itself (no generated range).
    """
    numbered = sequence_number(
        source.withColumn("_all", F.lit(0)), ["_all"], [order_col], name="_row"
    ).withColumn("_row", F.col("_row") - 1)
    n = source.agg(F.count(F.lit(1))).scalar()  # scalar subquery: one number, no join
    if n_events is None:
        draws = numbered.select(F.col("_row").alias("_i"))
    else:
        draws = source.sparkSession.range(n_events).select(F.col("id").alias("_i"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_i").cast("string"))), 1, 15), 16, 10)
    picks = draws.select((F.col("_i") + 1).alias("event_id"), F.pmod(drawn.cast("long"), n).alias("_row"))
    return picks.join(numbered.drop("_all"), "_row").drop("_row")
