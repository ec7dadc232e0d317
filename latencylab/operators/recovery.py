"""Fault-recovery analysis for all runs at once (WN4-WN6, JN10-JN12, AG22, AG27,
PRJ13, PRJ25, D18, D19).

Records are ordered per run by the effective timestamp (collected, else
processed; event id breaks ties). Gaps use the skew-safe ``neighbour`` scan, the
fault log (a handful of rows per run) is reduced to one interval per run and
equi-joined on ``run_id``; range predicates become labels, so no range join and
no per-run loop is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.functions.columns import effective_ts
from latencylab.operators.scan import TARGET_BLOCK_ROWS, neighbour, running_totals, value_statistics

# Missing-id ranges are generated in chunks so no array exceeds this many ids.
MISSING_CHUNK = 100_000


def timed_records(events: DataFrame, warmup_seconds: float = 0.0) -> DataFrame:
    """Records with an effective timestamp ``ts``, after the warm-up from the run's
    first timestamp."""
    rows = events.withColumn("ts", effective_ts()).where(F.col("ts").isNotNull())
    if warmup_seconds > 0:
        first = rows.groupBy("run_id").agg(F.min("ts").alias("_first"))
        rows = rows.join(first, "run_id").where(
            F.col("ts") >= F.col("_first") + F.lit(int(warmup_seconds * 1000))
        ).drop("_first")
    return rows


def gap_series(events: DataFrame, warmup_seconds: float = 0.0, target_rows: int = TARGET_BLOCK_ROWS) -> DataFrame:
    """Inter-message gaps: one row per consecutive pair of records in a run."""
    rows = timed_records(events, warmup_seconds).select("run_id", "event_id", "ts")
    nb = neighbour(rows, ["run_id"], ["ts", "event_id"], ["ts", "event_id"], "prev", "prev_", target_rows)
    return nb.where(F.col("prev_ts").isNotNull()).select(
        "run_id",
        (F.col("ts") - F.col("prev_ts")).alias("gap_ms"),
        F.col("prev_event_id").alias("before_event_id"),
        F.col("event_id").alias("after_event_id"),
        F.col("prev_ts").alias("before_ts"),
        F.col("ts").alias("after_ts"),
    )


GAP_FIELDS = ["gap_ms", "before_event_id", "after_event_id", "before_ts", "after_ts"]


def largest_gaps(gaps: DataFrame, conds: dict, keys=("run_id",)) -> DataFrame:
    """For each named condition, the largest qualifying gap per key, the earliest on
    ties. One hash aggregate finds every condition's maximum in a single pass; the
    tie rows (joined back on the one-row-per-key maxima) are the only input of the
    ``min_by`` that breaks ties."""
    keys = list(keys)
    flagged = gaps.withColumns({f"_c_{n}": c for n, c in conds.items()})
    best = flagged.groupBy(*keys).agg(
        *[F.max(F.when(F.col(f"_c_{n}"), F.col("gap_ms"))).alias(f"_m_{n}") for n in conds]
    )
    top = {n: F.col(f"_c_{n}") & (F.col("gap_ms") == F.col(f"_m_{n}")) for n in conds}
    any_top = None
    for c in top.values():
        any_top = c if any_top is None else (any_top | c)
    ties = flagged.join(best, keys).where(any_top)
    value = F.struct(*GAP_FIELDS)
    order = F.struct("before_ts", "after_ts")
    return ties.groupBy(*keys).agg(*[F.min_by(value, F.when(top[n], order)).alias(n) for n in conds])


def gap_stats(gaps: DataFrame) -> DataFrame:
    """Per run: number of gaps, typical (median) gap and the largest gap."""
    agg = value_statistics(gaps, ["run_id"], "gap_ms", {"typical_gap_ms": ("cont", 0.5)}, {"gap_count": "count"}).select(
        "run_id", "gap_count", "typical_gap_ms")
    top = largest_gaps(gaps, {"g": F.lit(True)}).select(
        "run_id", F.col("g.gap_ms").alias("max_gap_ms"), F.col("g.before_event_id").alias("max_gap_before_event_id"),
        F.col("g.after_event_id").alias("max_gap_after_event_id"),
    )
    return agg.join(top, "run_id", "left")


def missing_ranges(events: DataFrame) -> DataFrame:
    """The holes of a run's ids as ranges (run_id, lo, hi, n): one row per hole, however wide. Distinct ids
    are paired with the next id (skew-safe scan)."""
    ids = events.where(F.col("event_id").isNotNull()).select("run_id", "event_id").distinct()
    nb = neighbour(ids, ["run_id"], ["event_id"], ["event_id"], "next", "next_")
    lo, hi = F.col("event_id") + 1, F.col("next_event_id") - 1
    return nb.where(hi >= lo).select("run_id", lo.alias("lo"), hi.alias("hi"), (hi - lo + 1).alias("n"))


def missing_ids(events: DataFrame, chunk: int = MISSING_CHUNK) -> DataFrame:
    """Every id between a run's smallest and largest id that never arrived: the ranges, expanded.

    A hole is split in three steps of at most ``chunk`` parts each, with a shuffle between, so no array exceeds
    ``chunk`` entries (for holes up to its cube) and one wide hole is written by many tasks.
    """
    out = missing_ranges(events).select("run_id", "lo", "hi")
    for step in (chunk * chunk, chunk):
        wide = F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("c")
        out = out.select("run_id", "hi", wide).select(
            "run_id", F.col("c").alias("lo"), F.least(F.col("c") + F.lit(step - 1), F.col("hi")).alias("hi")
        )
    out = out.repartition("run_id", "lo")
    return out.select("run_id", F.explode(F.sequence("lo", "hi")).alias("missing_event_id"))


def fault_intervals(faults: DataFrame) -> DataFrame:
    """Per run: first ``fault_start`` and first ``fault_end`` in log order (time,
    phase, container); the end defaults to the start. Starts and ends of
    different attempts pair up this way, as in the reference."""
    order = F.struct("timestamp_ms", "phase", "container")
    start = F.col("phase") == "fault_start"
    end = F.col("phase") == "fault_end"
    agg = faults.groupBy("run_id").agg(
        F.min_by(F.struct("timestamp_ms", "service", "action"), F.when(start, order)).alias("s"),
        F.min_by(F.col("timestamp_ms"), F.when(end, order)).alias("e"),
    )
    return agg.where(F.col("s").isNotNull()).select(
        "run_id",
        F.col("s.service").alias("fault_service"),
        F.col("s.action").alias("fault_action"),
        F.col("s.timestamp_ms").alias("fault_start_ms"),
        F.coalesce(F.col("e"), F.col("s.timestamp_ms")).alias("fault_end_ms"),
        F.col("e").isNotNull().alias("has_fault_end"),
    )


def fault_attempts(faults: DataFrame) -> DataFrame:
    """Each ``fault_start`` with the first ``fault_end`` at or after it and before the
    next start (null when the attempt never ended).

    The log is numbered by a running count of starts (ends at the same instant
    sort after the start), so every end carries the attempt it closes; no start x
    end pairs are formed.
    """
    log = faults.where(F.col("phase").isin("fault_start", "fault_end")).withColumns({
        "_is_start": (F.col("phase") == "fault_start").cast("int"), "_end_last": (F.col("phase") == "fault_end").cast("int"),
    })
    log = running_totals(log, ["run_id"], ["timestamp_ms", "_end_last", "container"], sums={"attempt": F.col("_is_start").cast("long")})
    starts = log.where(F.col("_is_start") == 1).select(
        "run_id", "attempt", "service", "action", F.col("timestamp_ms").alias("fault_start_ms")
    )
    ends = (
        log.where((F.col("_is_start") == 0) & (F.col("attempt") > 0))
        .groupBy("run_id", "attempt")
        .agg(F.min("timestamp_ms").alias("fault_end_ms"))
    )
    return starts.join(ends, ["run_id", "attempt"], "left")


def fault_gaps(gaps: DataFrame, intervals: DataFrame) -> DataFrame:
    """Largest gap before the fault, after recovery, and around/after the fault
    (every gap spanning the start or beginning at or after it)."""
    g = gaps.join(intervals.select("run_id", "fault_start_ms", "fault_end_ms"), "run_id")
    s, e = F.col("fault_start_ms"), F.col("fault_end_ms")
    bts, ats = F.col("before_ts"), F.col("after_ts")
    conds = {"pre_fault": ats < s, "post_fault": bts > e, "fault_window": ((bts <= s) & (s <= ats)) | (bts >= s)}
    top = largest_gaps(g, conds)
    cols = ["run_id"]
    for name in conds:
        cols += [F.col(f"{name}.gap_ms").alias(f"{name}_gap_ms"),
                 F.col(f"{name}.before_event_id").alias(f"{name}_before_event_id"),
                 F.col(f"{name}.after_event_id").alias(f"{name}_after_event_id")]
    return intervals.select("run_id").join(top.select(*cols), "run_id", "left")


SECTIONS = ("pre_all", "post_all", "pre_window", "post_window", "fault_interval")


def fault_latency_sections(events: DataFrame, intervals: DataFrame, window_seconds: float = 15.0,
                           warmup_seconds: float = 0.0) -> DataFrame:
    """Latency n / mean / true median / nearest-rank p95 / max per run and section:
    before the fault, after recovery, the same within ±window, and during it.
    A record can fall in two sections; labels are exploded, then aggregated."""
    w = int(window_seconds * 1000)
    rows = timed_records(events, warmup_seconds).where(F.col("latency_ms").isNotNull())
    rows = rows.select("run_id", "ts", "latency_ms").join(
        intervals.select("run_id", "fault_start_ms", "fault_end_ms"), "run_id"
    )
    ts, s, e = F.col("ts"), F.col("fault_start_ms"), F.col("fault_end_ms")
    labels = F.array(
        F.when(ts < s, F.lit("pre_all")),
        F.when(ts > e, F.lit("post_all")),
        F.when((s - w <= ts) & (ts < s), F.lit("pre_window")),
        F.when((e < ts) & (ts <= e + w), F.lit("post_window")),
        F.when((s <= ts) & (ts <= e), F.lit("fault_interval")),
    )
    exploded = rows.select("run_id", "latency_ms", F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("section"))
    keys = ["run_id", "section"]
    return value_statistics(
        exploded, keys, "latency_ms", {"median_latency_ms": ("cont", 0.5), "p95_latency_ms": ("disc", 0.95)},
        {"n": "count", "avg_latency_ms": "avg", "max_latency_ms": "max"},
    ).select(*keys, "n", "avg_latency_ms", "max_latency_ms", "median_latency_ms", "p95_latency_ms")


def fault_attempt_sections(events: DataFrame, attempts: DataFrame, window_seconds: float = 15.0, warmup_seconds: float = 0.0,
                           bin_seconds: float = 60.0) -> DataFrame:
    """Latency n / mean / true median / nearest-rank p95 / max around every fault attempt: within the window before its start,
    during it (an attempt that never ended is its start alone), and within the window after its end.

    A record may lie in sections of several attempts. Attempts are spread over the time bins that they and their windows
    touch, records have one bin, and the two meet by an equi-join on (run, bin): no range join, and a run with many attempts or
    records is many keys. Sections without a record have no row; an attempt without a start time takes no part."""
    w, width = int(window_seconds * 1000), int(bin_seconds * 1000)
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    spans = attempts.where(F.col("fault_start_ms").isNotNull()).select(
        "run_id", "attempt", F.col("fault_start_ms").alias("s"), F.coalesce("fault_end_ms", "fault_start_ms").alias("e"))
    spans = spans.select("*", F.explode(F.sequence(bin_of(F.col("s") - w), bin_of(F.col("e") + w))).alias("bin"))
    rows = timed_records(events, warmup_seconds).where(F.col("latency_ms").isNotNull()).select("run_id", "ts", "latency_ms", bin_of(F.col("ts")).alias("bin"))
    ts, s, e = F.col("ts"), F.col("s"), F.col("e")
    section = (
        F.when((s - w <= ts) & (ts < s), F.lit("pre_window"))
        .when((s <= ts) & (ts <= e), F.lit("fault_interval"))
        .when((e < ts) & (ts <= e + w), F.lit("post_window"))
    )
    met = rows.join(spans, ["run_id", "bin"]).select("run_id", "attempt", section.alias("section"), "latency_ms").where(F.col("section").isNotNull())
    keys = ["run_id", "attempt", "section"]
    return value_statistics(
        met, keys, "latency_ms", {"median_latency_ms": ("cont", 0.5), "p95_latency_ms": ("disc", 0.95)},
        {"n": "count", "avg_latency_ms": "avg", "max_latency_ms": "max"},
    ).select(*keys, "n", "avg_latency_ms", "max_latency_ms", "median_latency_ms", "p95_latency_ms")
