"""Connected components of a link table by alternating stars (all DataFrame operations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.llm.blocks import scratch


def _star(edges: DataFrame, pick) -> DataFrame:
    """Each vertex u points its chosen neighbours, given its least neighbour m (or itself), at m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pick(edges.join(least, "u")).filter(F.col("u") != F.col("v")).groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """(id, component): the least id reachable from each id that occurs in a link.

    Large stars point a vertex's larger neighbours at its least neighbour, small stars its smaller
    ones and itself; the rounds end when nothing changes (logarithmically many). The least
    neighbour is a map-side combined aggregate, so a vertex with very many links is no hot task, and
    every round is a written table. Links from an id to itself and repeats are ignored.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")
    edges = scratch(spark, edges, name)
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, lambda e: e.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _star(
            large,
            lambda e: e.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v"),
        )
        edges = scratch(spark, small, name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        state = tuple(now)
