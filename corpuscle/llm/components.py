"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from corpuscle.llm.common import discard, keep, kept_path


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour is tied to the least of u and its neighbours. Small: every smaller one, and u."""
    near = edges if large else edges.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = near.join(least, "u")
    if large:
        tied = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, component (the least node reachable) for every node of a table of undirected links.

    Links with a null end and links of a node to itself are ignored; nodes without a link are not returned. Each
    round ends in a written table, so that plans stay short and a lost executor costs a round at most; the rounds
    grow with the logarithm of the longest path. A hub's rows are only joined and aggregated, never gathered.
    """
    spark = links.sparkSession
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct()
    edges = keep(edges, "links")
    before = None
    while True:
        seen = Observation()
        round_ = _star(_both(_star(_both(edges), large=True)), large=False)
        marked = round_.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
        after = keep(marked, "links")
        if edges.isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        discard(spark, kept_path(edges))
        edges, now = after, (seen.get["n"], seen.get["x"])
        if now == before:
            least = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least)
        before = now
