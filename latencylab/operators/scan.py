"""Skew-safe ordered scans within a key: row numbers, running totals, neighbours, percentiles.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one
task, so a run or account holding a third of the rows becomes one straggler task.
These operators cut each large key into *blocks* of consecutive rows, do the ordered
work inside ``(key, block)`` partitions, and carry the per-block result (count,
sum, max, edge row) forward with a window over the block summaries, one row per block.

Blocks are cut at points of the full sort order, (order columns) as one tuple, taken
from a hash sample of the key's rows: a dense key beside sparse ones, many equal timestamps
(the tiebreak column splits them) and sparse ids are all cut to about ``target_rows``. Keys
below that size are one block. The cut points are one value, the result of a scalar subquery: a point per
million rows, so about 50 MB for 10^12 rows. A row finds its block by binary search, whose steps do not
depend on the number of blocks. The points follow from the rows alone, so every branch of a plan, and a task that
runs again, cuts alike (bounds sampled by a range exchange would differ between branches that prune other columns).

Null keys and null order values are ordinary values (nulls first): no row is lost. The
order columns give a total order within a key when the result depends on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLK = "_blk"

# Rows per block, and sampled rows per block from which the cut points are taken.
TARGET_BLOCK_ROWS = 1_000_000
SAMPLES_PER_BLOCK = 32
# A key has fewer than 2 ** MAX_CUT_BITS cut points (4 * 10^12 rows in blocks of the usual size).
MAX_CUT_BITS = 22


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_j_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_j_{k}" for k in keys])


def with_blocks(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], target_rows: int = TARGET_BLOCK_ROWS,
                drawn_by: Sequence[str] = ()) -> DataFrame:
    """Adds the block number of each row: how many of its key's cut points are at or before it.

    ``drawn_by`` names further columns that decide which rows are sampled. With an aggregate's result among them, the sample is
    drawn after the aggregate and shares its exchange with the rest of the plan, instead of reading the input once more."""
    step = max(1, target_rows // SAMPLES_PER_BLOCK)
    point, key = F.struct(*order_cols), F.xxhash64(F.lit(1), *keys)
    drawn = F.pmod(F.xxhash64(F.lit(2), *keys, *order_cols, *drawn_by), F.lit(step)) == 0
    cuts = (
        df.where(drawn).groupBy(key.alias("k"))
        .agg(F.array_sort(F.collect_list(point)).alias("points"))
        .where(F.size("points") > SAMPLES_PER_BLOCK)
        .select("k", F.filter("points", lambda p, i: i % SAMPLES_PER_BLOCK == SAMPLES_PER_BLOCK - 1).alias("cuts"))
        .agg(F.map_from_entries(F.collect_list(F.struct("k", "cuts"))).alias("all"))
        .scalar()
    )
    found = df.withColumn("_cuts", F.try_element_at(cuts, key))
    # never null, so that no join on it makes the optimizer search the blocks of rows further up for nulls
    number = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.coalesce(_cuts_up_to(point), F.lit(0)))
    return found.withColumn(_BLK, number.cast("long")).drop("_cuts")


def _cuts_up_to(point: Column) -> Column:
    """How many of the ascending ``_cuts`` are at or before ``point``, by binary search: the answer grows by a
    power of two at a time as long as the cut it reaches is not after the point."""

    def grow(n: Column, power: Column) -> Column:
        fits = (n + power <= F.size("_cuts")) & (F.try_element_at("_cuts", n + power) <= point)
        return F.when(fits, n + power).otherwise(n)

    return F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(MAX_CUT_BITS))]), F.lit(0), grow)


def _columns(order_cols: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in order_cols]


def _stand_ins(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """``df`` with each nullable key replaced by columns that are never null, their names, and the expressions that give the
    keys back. Null-safe equality then is plain equality of the stand-ins, so windows and joins on them share one
    partitioning and one sort (a null-safe join condition would shuffle the rows again)."""
    plain: dict[str, Column] = {}
    names: list[str] = []
    back: dict[str, Column] = {}
    for i, k in enumerate(keys):
        field = df.schema[k]
        if not field.nullable:
            names.append(k)
            continue
        kind = field.dataType
        if isinstance(kind, (T.NumericType, T.StringType)):
            plain |= {f"_k{i}": F.coalesce(F.col(k), F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)), f"_k{i}_null": F.col(k).isNull()}
            back[k] = F.when(~F.col(f"_k{i}_null"), F.col(f"_k{i}"))
        else:
            plain[f"_k{i}"] = F.struct(F.col(k))
            back[k] = F.col(f"_k{i}")[k]
        names += [c for c in plain if c.split("_")[1] == f"k{i}"]
    return df.withColumns(plain).drop(*back) if plain else df, names, back


def _restored(out: DataFrame, back: dict[str, Column], columns: Sequence[str]) -> DataFrame:
    return out.withColumns(back).select(*columns) if back else out.select(*columns)


def _blocked(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], target_rows: int, drawn_by: Sequence[str] = ()):
    """(rows with block numbers and key stand-ins, partition columns, block columns, expressions of the keys). An order column that is
    a key as well stays available under its name."""
    b = with_blocks(df, keys, order_cols, target_rows, drawn_by)
    both = [c for c in order_cols if c in keys]
    b, names, back = _stand_ins(b, [k for k in keys if k not in both])
    return b, names + both, [*names, *both, _BLK], back


def _carry(local: DataFrame, names: Sequence[str], cols: dict[str, Column]) -> DataFrame:
    """Block summaries (one row per block) with ``cols``, windows over the blocks of a key."""
    return local.select(*names, _BLK, *[c.alias(n) for n, c in cols.items()])


def _blocks_of(names: Sequence[str]):
    return Window.partitionBy(*names).orderBy(_BLK)


def _before(names: Sequence[str]):
    return _blocks_of(names).rowsBetween(Window.unboundedPreceding, -1)


def sequence_number(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], name: str = "seq",
                    target_rows: int = TARGET_BLOCK_ROWS) -> DataFrame:
    """Exact ``row_number()`` within ``keys`` ordered by ``order_cols`` (1-based, long)."""
    b, names, block, back = _blocked(df, list(keys), order_cols, target_rows)
    order = Window.partitionBy(*block).orderBy(*_columns(order_cols))
    local = b.withColumns({"_local": F.row_number().over(order), "_closes": F.lead(F.lit(1)).over(order).isNull()})
    carry = _carry(local.where("_closes"), names, {"_off": F.coalesce(F.sum("_local").over(_before(names)), F.lit(0))})
    out = local.join(carry, block).withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
    return _restored(out, back, [*[c for c in df.columns if c != name], name])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order_cols: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    peers: bool = False,
    target_rows: int = TARGET_BLOCK_ROWS,
    whole: dict[str, str] | None = None,
    drawn_by: Sequence[str] = (),
) -> DataFrame:
    """Running sums / maxima from the start of the key up to each row.

    ``sums`` and ``maxes`` map output names to Column expressions; ``whole`` maps the name of a column for the key's total to
    the name of a sum. With ``peers=True`` rows with equal order values share one value (a RANGE frame:
    all rows of a micro-batch see the batch-end total): the rows are first
    pre-aggregated per (key, order value) with a partial+final hash aggregate, the
    running scan runs over those aggregated rows, and the totals are joined back, so
    neither a key with many order values nor one huge peer group lands in a single
    window partition. ``drawn_by``: see :func:`with_blocks`.
    """
    keys, order_cols = list(keys), list(order_cols)
    sums = dict(sums or {})
    maxes = dict(maxes or {})
    if peers:
        per_peer = df.groupBy(*keys, *order_cols).agg(
            *[F.sum(e).alias(f"_p_{n}") for n, e in sums.items()],
            *[F.max(e).alias(f"_p_{n}") for n, e in maxes.items()],
        )
        scanned = running_totals(
            per_peer, keys, order_cols, sums={n: F.col(f"_p_{n}") for n in sums},
            maxes={n: F.col(f"_p_{n}") for n in maxes}, target_rows=target_rows,
        ).drop(*[f"_p_{n}" for n in {**sums, **maxes}])
        return null_safe_join(df, scanned, [*keys, *order_cols])
    valued = df.withColumns({f"_v_{n}": e for n, e in {**sums, **maxes}.items()})
    b, names, block, back = _blocked(valued, keys, order_cols, target_rows, drawn_by)
    order = Window.partitionBy(*block).orderBy(*_columns(order_cols))
    w = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = b.withColumns({
        **{f"_l_{n}": F.sum(f"_v_{n}").over(w) for n in sums},
        **{f"_l_{n}": F.max(f"_v_{n}").over(w) for n in maxes},
        "_closes": F.lead(F.lit(1)).over(order).isNull(),
    })
    # the totals of a block are those of its last row: a filter of the window output, no aggregate
    carry = _carry(local.where("_closes"), names, {
        **{f"_c_{n}": F.sum(f"_l_{n}").over(_before(names)) for n in sums},
        **{f"_c_{n}": F.max(f"_l_{n}").over(_before(names)) for n in maxes},
        **{f"_w_{t}": F.sum(f"_l_{n}").over(Window.partitionBy(*names)) for t, n in (whole or {}).items()},
    })
    out = local.join(carry, block).withColumns({
        # sum semantics: null only when every value so far is null
        **{n: F.when(F.col(f"_c_{n}").isNull(), F.col(f"_l_{n}"))
           .when(F.col(f"_l_{n}").isNull(), F.col(f"_c_{n}"))
           .otherwise(F.col(f"_c_{n}") + F.col(f"_l_{n}")) for n in sums},
        **{n: F.greatest(F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n in maxes},
        **{t: F.col(f"_w_{t}") for t in whole or {}},
    })
    made = [*sums, *maxes, *(whole or {})]
    return _restored(out, back, [*[c for c in df.columns if c not in made], *made])


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order_cols: Sequence[str],
    cols: Sequence[str],
    direction: str = "prev",
    prefix: str = "prev_",
    target_rows: int = TARGET_BLOCK_ROWS,
) -> DataFrame:
    """Attach the previous (``lag``) or next (``lead``) row's ``cols`` within ``keys``.

    Output columns are ``prefix + col``; null on the first (last) row of a key.
    ``order_cols`` must be a total order inside a key.
    """
    if direction not in ("prev", "next"):
        raise ValueError("direction must be 'prev' or 'next'")
    packed = F.struct(*[F.col(c) for c in cols])
    b, names, block, back = _blocked(df.withColumn("_cols", packed), list(keys), order_cols, target_rows)
    w = Window.partitionBy(*block).orderBy(*_columns(order_cols))
    near, far = (F.lag, F.lead) if direction == "prev" else (F.lead, F.lag)
    # the neighbour, and whether this row is at the edge of its block that the next block looks at
    local = b.withColumns({"_nb": near("_cols").over(w), "_edge_row": far(F.lit(1)).over(w).isNull()})
    # one edge row per block, taken from the window output (a filter, no aggregate)
    carry = _carry(local.where("_edge_row"), names, {"_carry": near("_cols").over(_blocks_of(names))})
    out = local.join(carry, block).withColumn("_nb", F.coalesce("_nb", "_carry"))
    made = {prefix + c: F.col("_nb")[c] for c in cols}
    return _restored(out.withColumns(made), back, [*[c for c in df.columns if c not in made], *made])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, tuple[str, float]],
                target_rows: int = TARGET_BLOCK_ROWS, weight: str | None = None) -> DataFrame:
    """Exact percentiles per key: the percentiles of :func:`value_statistics` alone."""
    return value_statistics(df, keys, value, wanted, target_rows=target_rows, weight=weight)


def value_statistics(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, tuple[str, float]] | None = None,
                     moments: dict[str, str] | None = None, extra: dict[str, tuple] | None = None,
                     target_rows: int = TARGET_BLOCK_ROWS, weight: str | None = None) -> DataFrame:
    """Exact percentiles and other statistics of a column per key, from one read of the rows.

    ``wanted`` maps output names to ("disc" | "cont", p): "disc" is the nearest rank (index ceil(p n), at least 1), "cont"
    interpolates between ranks. ``moments`` maps output names to "count", "avg", "stddev" (sample; null below two values) or "max";
    ``extra`` maps output names to (aggregate function, column) for functions that combine with themselves, like min and max.

    Equal values are counted first (partial + final hash aggregate), a running count over the
    distinct values gives every value's last rank, and the value at a rank is the least one
    whose running count reaches it; the moments follow from the counted values and the group's totals. No buffer grows with a
    group, unlike the built-in exact percentile, whose value map of a hot group ends in one task. The counted values feed the
    cut points, the running count and the totals alike, so the input is read once. Rows whose value is null are skipped; a
    key without values has no row. ``weight`` names a column that says how often each row counts.
    """
    keys, wanted, moments, extra = list(keys), wanted or {}, moments or {}, extra or {}
    x = F.col("_x").cast("double")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"), *[fn(c).alias(f"_e_{n}") for n, (fn, c) in extra.items()])
    sums, whole = {"_cum": F.col("_c")}, {"_n": "_cum"}
    if {"avg", "stddev"} & set(moments.values()):
        sums["_part"], whole["_sum"] = x * F.col("_c"), "_part"
    ranked = running_totals(counts, keys, ["_x"], sums=sums, whole=whole, target_rows=target_rows, drawn_by=["_c"])

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_cum") >= rank, x))

    aggs = {"_n": F.max("_n")}
    for name, (kind, p) in wanted.items():
        if kind == "disc":
            aggs[name] = at(F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_n"))))
        else:
            pos = F.lit(p) * (F.col("_n") - 1)
            aggs[f"{name}_lo"], aggs[f"{name}_hi"] = at(F.floor(pos) + 1), at(F.ceil(pos) + 1)
    off = x - F.col("_sum") / F.col("_n")
    of = {"count": lambda: F.max("_n"), "avg": lambda: F.max("_sum") / F.max("_n"), "max": lambda: F.max(x),
          "stddev": lambda: F.sqrt(F.sum(off * off * F.col("_c")) / F.nullif(F.max("_n") - 1, F.lit(0)))}
    aggs |= {n: of[kind]() for n, kind in moments.items()} | {n: fn(f"_e_{n}") for n, (fn, _) in extra.items()}
    out = ranked.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    picked = []
    for name, (kind, p) in wanted.items():
        if kind == "disc":
            picked.append(F.col(name))
        else:
            pos = F.lit(p) * (F.col("_n") - 1)
            lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
            picked.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, *picked, *moments, *extra)


def arg_extreme(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str],
                largest: bool = False, names: Sequence[str] | None = None) -> DataFrame:
    """Per key, the ``cols`` of the row with the lexicographically smallest (or
    largest) ``order`` tuple; of rows equal in all of it the smallest (largest) by ``cols``.

    ``min_by``/``max_by`` with a struct needs a sort-based aggregate (its buffer is
    not fixed-width), i.e. a sort of every row. Here the leading order component is
    a fixed-width hash aggregate (partial + final) over all rows, joined back to
    keep the rows that reach it (one row per key on the small side); only those ties
    go through ``min``/``max`` of the remaining tuple. The leading
    component must be numeric; rows with a null leading component are skipped."""
    keys = list(keys)
    names = list(names or cols)
    fn = F.max if largest else F.min
    cand = df.select(*keys, *[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_x_{n}") for c, n in zip(cols, names)])
    best = cand.where(F.col("_o0").isNotNull()).groupBy(*keys).agg(fn("_o0").alias("_o0"))
    ties = null_safe_join(cand, best, [*keys, "_o0"])
    rest = F.struct(*[F.col(f"_o{i}") for i in range(1, len(order))], *[F.col(f"_x_{n}") for n in names])
    agg = ties.groupBy(*keys).agg(fn(rest).alias("_v"))
    return agg.select(*keys, *[F.col(f"_v._x_{n}").alias(n) for n in names])
