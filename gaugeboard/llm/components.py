"""Connected components of a distributed edge list, by alternating star contractions.

Each round replaces edges by edges to smaller neighbours until every component is a star
around its smallest node.  The edges stay distributed; each round's result is a written table,
so lost executors cost one round.  Only the number of changed rows reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeboard.session import materialize


def _least(edges: DataFrame) -> DataFrame:
    """Least neighbour of each u; the aggregation works before the shuffle, so a hub is no hot key."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), "u").withColumn("m", F.least("m", "u"))
    return joined.filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least(down), "u")
    links = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.union(joined.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (u, v) edges; component: its least node.

    Loops and repeated edges do no harm; NULL ends are dropped.
    """
    edges = materialize(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        now = _digest(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
