"""Blocked (skew-safe) scans equal plain per-key windows, with a hot key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from latencylab.operators.scan import neighbour, percentiles, running_totals, sequence_number, with_blocks


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 20)}"  # one key holds a third of the rows
        rows.append((key, i * 3 + rnd.randint(0, 2), rnd.choice([None, rnd.uniform(0, 100)]), rnd.randint(0, 40)))
    return spark.createDataFrame(rows, "k string, o long, v double, batch long")


def test_sequence_number_equals_row_number(spark):
    df = _data(spark)
    got = sequence_number(df, ["k"], ["o"], name="seq", target_rows=50)
    ref = df.withColumn("seq", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("long"))
    assert got.exceptAll(ref.select(*got.columns)).count() == 0
    assert got.count() == df.count()


def test_running_totals_rows_and_peers(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    got = running_totals(df, ["k"], ["o"], sums={"s": F.col("v"), "c": F.lit(1).cast("long")},
                         maxes={"m": F.col("v")}, target_rows=64)
    ref = df.withColumn("s", F.sum("v").over(w)).withColumn("c", F.count(F.lit(1)).over(w)).withColumn(
        "m", F.max("v").over(w))
    r6 = lambda d: d.select("k", "o", F.round("s", 6).alias("s"), "c", "m")
    assert r6(got).exceptAll(r6(ref)).count() == 0
    wp = Window.partitionBy("k").orderBy("batch").rangeBetween(Window.unboundedPreceding, 0)
    gotp = running_totals(df, ["k"], ["batch"], sums={"c": F.lit(1).cast("long")}, peers=True, target_rows=7)
    refp = df.withColumn("c", F.count(F.lit(1)).over(wp))
    assert gotp.select("k", "o", "c").exceptAll(refp.select("k", "o", "c")).count() == 0


def test_neighbour_prev_and_next(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("o")
    got = neighbour(df, ["k"], ["o"], ["o", "v"], "prev", "p_", target_rows=40)
    ref = df.withColumn("p_o", F.lag("o").over(w)).withColumn("p_v", F.lag("v").over(w))
    assert got.select("k", "o", "p_o", "p_v").exceptAll(ref.select("k", "o", "p_o", "p_v")).count() == 0
    got = neighbour(df, ["k"], ["o"], ["o"], "next", "n_", target_rows=40)
    ref = df.withColumn("n_o", F.lead("o").over(w))
    assert got.select("k", "o", "n_o").exceptAll(ref.select("k", "o", "n_o")).count() == 0


def _largest_block(df, keys, order, target):
    return with_blocks(df, keys, order, target).groupBy(*keys, "_blk").count().agg(F.max("count")).first()[0]


def test_one_dense_run_among_year_long_runs_is_split(spark):
    dense = spark.range(300_000).select(F.lit("dense").alias("k"), F.col("id").alias("o"))
    wide = spark.range(50_000).select(F.concat(F.lit("w"), F.col("id") % 5).alias("k"), (F.col("id") * 3_000_000).alias("o"))
    df = dense.unionByName(wide)
    assert _largest_block(df, ["k"], ["o"], 10_000) <= 20_000
    got = sequence_number(df, ["k"], ["o"], target_rows=10_000).where("k = 'dense' and seq <> o + 1")
    assert got.count() == 0


def test_a_million_equal_timestamps_are_split_by_the_tiebreak(spark):
    df = spark.range(1_000_000).select(F.lit("r").alias("k"), F.lit(77).cast("long").alias("ts"), "id")
    assert _largest_block(df, ["k"], ["ts", "id"], 50_000) <= 100_000


def test_sparse_ids_make_full_blocks(spark):
    df = spark.range(100_000).select(F.lit("r").alias("k"), (F.col("id") * 10**13).alias("o"))
    blocks = with_blocks(df, ["k"], ["o"], 10_000).select("_blk").distinct().count()
    assert 5 <= blocks <= 20


def test_null_keys_and_null_order_values_keep_their_rows(spark):
    rows = [(None, 1, 2.0), (None, None, 3.0), ("a", None, 4.0), ("a", None, 5.0), ("a", 2, None), ("b", 7, 1.0)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    for peers in (False, True):
        got = running_totals(df, ["k"], ["o"], sums={"s": F.col("v"), "n": F.lit(1).cast("long")}, peers=peers)
        assert got.count() == len(rows)
    last = {(r.k, r.o): (r.s, r.n) for r in got.collect()}
    assert last[("a", None)] == (9.0, 2) and last[("a", 2)] == (9.0, 3) and last[(None, 1)] == (5.0, 2)
    assert neighbour(df, ["k"], ["o", "v"], ["v"]).count() == len(rows)
    assert sequence_number(df, ["k"], ["o", "v"]).count() == len(rows)


def test_percentiles_equal_the_built_in_ones(spark):
    df = _data(spark).withColumn("v", F.round("v", 0))
    got = percentiles(df, ["k"], "v", {"m": ("cont", 0.5), "p": ("cont", 0.95), "d": ("disc", 0.95), "z": ("disc", 0.0)}, target_rows=40)
    want = df.groupBy("k").agg(
        F.expr("percentile_cont(0.5) within group (order by v)").alias("m"), F.expr("percentile_cont(0.95) within group (order by v)").alias("p"),
        F.expr("percentile_disc(0.95) within group (order by v)").alias("d"), F.min("v").alias("z"),
    )
    as_rows = lambda d: sorted((r.k, round(r.m, 9), round(r.p, 9), r.d, r.z) for r in d.collect())
    assert as_rows(got) == as_rows(want)


def test_blocks_are_numbered_by_the_cuts_at_or_before_a_row(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") * 7 % 20_000).alias("o"))
    got = with_blocks(df, ["k"], ["o"], 100).collect()
    rows = sorted((r.o, r._blk) for r in got)
    numbers = [b for _, b in rows]
    assert numbers == sorted(numbers) and numbers[0] == 0 and set(numbers) == set(range(numbers[-1] + 1)) and 100 < numbers[-1] < 400


def test_value_statistics_in_one_pass(spark):
    from latencylab.operators.scan import value_statistics

    df = _data(spark)
    got = value_statistics(df, ["k"], "v", {"m": ("cont", 0.5)}, {"n": "count", "a": "avg", "s": "stddev", "x": "max"}, {"first": (F.min, "o")}, target_rows=40)
    want = df.where("v is not null").groupBy("k").agg(
        F.expr("percentile_cont(0.5) within group (order by v)").alias("m"), F.count("v").alias("n"), F.avg("v").alias("a"), F.stddev_samp("v").alias("s"),
        F.max("v").alias("x"), F.min("o").alias("first"))
    near = lambda d: sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in d.select("k", "m", "n", "a", "s", "x", "first").collect())
    assert near(got) == near(want)
