"""Graphs and trees: bounded search, ancestors, descendants, cycles, validation.

Edges are plain DataFrames. Each step is one join on keys; the depth is a bound or the tree's own.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both_ways(edges: DataFrame, source: str, target: str) -> DataFrame:
    a = edges.select(F.col(source).alias("a"), F.col(target).alias("b"))
    return a.unionByName(a.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, node: str, depth: int, source: str, target: str, kind: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """node and hops of all within ``depth`` (0 to 3) undirected steps of the seeds, seeds included.

    ``kinds`` limits the edges; an empty list leaves the seeds alone.
    """
    if not 0 <= depth <= 3:
        raise ValueError("depth must be from 0 to 3")
    if kinds is not None:
        edges = edges.where(F.col(kind).isin(kinds)) if kinds else edges.where("false")
    step = _both_ways(edges, source, target)
    seen = seeds.select(F.col(node).alias("node")).distinct().withColumn("hops", F.lit(0))
    edge_of = seen
    for hop in range(1, depth + 1):
        edge_of = edge_of.join(step, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().withColumn("hops", F.lit(hop))
        edge_of = edge_of.join(seen, "node", "left_anti")
        seen = seen.unionByName(edge_of)
    return seen


def ancestors(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """node, ancestor and hops, nearest first; a cycle ends where it closes.

    Walks up one join a level until no row is left, however deep the tree; each level is checkpointed, so that none is
    computed again for the next or for the result.
    """
    up = tree.where(F.col(parent).isNotNull()).select(F.col(node).alias("__n"), F.col(parent).alias("__p"))
    level = up.select(F.col("__n").alias("node"), F.col("__p").alias("ancestor"), F.lit(1).alias("hops"), F.array("__n").alias("seen")).where("node <> ancestor")
    level = out = _cut(level)
    hop = 1
    while not level.isEmpty():
        hop += 1
        level = level.join(up, F.col("ancestor") == F.col("__n")).where(~F.array_contains("seen", F.col("__p")) & (F.col("__p") != F.col("ancestor")))
        level = _cut(level.select("node", F.col("__p").alias("ancestor"), F.lit(hop).alias("hops"), F.concat("seen", F.array("__n")).alias("seen")))
        out = out.unionByName(level)
    return out.select("node", "ancestor", "hops")


def descendants(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """node, descendant and hops."""
    return ancestors(tree, node, parent).select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "hops")


def in_cycle(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """Nodes whose chain of parents comes back to them.

    The nodes that lie on no cycle are peeled from both ends, a level a round: first what no one names as parent, then
    what has no parent left. Rounds are the depth of the tree hung on the cycles, each cut off by a checkpoint.
    """
    left = _cut(tree.where(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("up")))
    size = left.count()
    while True:
        named, held = left.select(F.col("up").alias("node")), left.select(F.col("node").alias("up"))
        left = _cut(left.join(named, "node", "left_semi").join(held, "up", "left_semi").select("node", "up"))
        before, size = size, left.count()
        if size == before:
            break
    return left.select("node").distinct()


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's shared folder; in a local session without one, a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpuscle-"))
    return df.checkpoint()


def nearest_of(chains: DataFrame, kinds: DataFrame, wanted: list[str]) -> DataFrame:
    """For every node the nearest ancestor of each wanted kind: a column a kind. kinds: ancestor, kind."""
    rows = chains.join(kinds, "ancestor")
    return rows.groupBy("node").agg(*(F.min_by("ancestor", F.when(F.col("kind") == k, F.col("hops"))).alias(k) for k in wanted))


def summed_up(tree: DataFrame, node: str, parent: str, values: list[str]) -> DataFrame:
    """Each node's values plus those of all its ancestors, and its depth."""
    chains = ancestors(tree, node, parent)
    above = tree.select(F.col(node).alias("ancestor"), *(F.col(v).alias(f"__{v}") for v in values))
    sums = chains.join(above, "ancestor").groupBy(F.col("node").alias(node)).agg(F.max("hops").alias("depth"), *(F.sum(f"__{v}").alias(f"__{v}") for v in values))
    return tree.join(sums, node, "left").select(node, F.coalesce("depth", F.lit(0)).alias("depth"), *((F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values))


def parents_first(tree: DataFrame, node: str, parent: str, order: str) -> DataFrame:
    """Nodes with their depth, in an order in which parents come before children."""
    depth = ancestors(tree, node, parent).groupBy(F.col("node").alias(node)).agg(F.max("hops").alias("depth"))
    return tree.join(depth, node, "left").withColumn("depth", F.coalesce("depth", F.lit(0))).orderBy("depth", order)


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pointer, message) of an architecture: repeated ids, unknown ends and parents, self-edges, parent cycles.

    nodes: id, parent, pos; edges: id, source, target, pos.
    """
    from corpuscle.operators.relational import dangling, duplicates

    ids = nodes.select(F.col("id").alias("known")).distinct()
    at = lambda part, tail: F.concat(F.lit(f"/{part}/"), F.col("pos"), F.lit(tail))
    say = lambda df, part, tail, what: df.select(at(part, tail).alias("pointer"), F.lit(what).alias("message"))
    out = say(duplicates(nodes, ["id"], "pos"), "nodes", "/id", "repeated node id")
    out = out.unionByName(say(duplicates(edges, ["id"], "pos"), "edges", "/id", "repeated edge id"))
    out = out.unionByName(say(dangling(edges, "source", ids, "known"), "edges", "/source", "unknown node"))
    out = out.unionByName(say(dangling(edges, "target", ids, "known"), "edges", "/target", "unknown node"))
    out = out.unionByName(say(dangling(nodes, "parent", ids, "known"), "nodes", "/parent", "unknown parent"))
    out = out.unionByName(say(edges.where("source = target"), "edges", "", "edge from a node to itself"))
    cyclic = in_cycle(nodes, "id", "parent").select(F.col("node").alias("id"))
    return out.unionByName(say(nodes.join(cyclic, "id", "left_semi"), "nodes", "/parent", "parent cycle"))
