"""Weighted expansion of seeds through a graph, and communities of a graph under the constant Potts model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.operators.graph import _cut

#: Weights by kind of edge, fixed values: on the way from a seed, and as evidence that two nodes belong together.
REACH = {"calls": 1.0, "extends": 0.9, "handles": 0.9, "imports": 0.6, "references": 0.5, "db_query": 0.5, "http_call": 0.5, "reads_env": 0.4}
TOGETHER = {"imports": 2.0, "extends": 2.0, "calls": 1.0}
GUESSED = 0.5
SAME_COMMUNITY = 0.5


def weight_of(kind: Column, weights: dict[str, float], otherwise: float | None = None) -> Column:
    """The weight of a kind of edge; null, so that an edge counts for nothing, where none is named."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[kind], F.lit(otherwise).cast("double"))


def expanded(edges: DataFrame, seeds: DataFrame, members: DataFrame, depth: int = 2, most: int = 200) -> DataFrame:
    """What seeds lead to: query, node, seed, hops, weight, score, best first by score and node within a query.

    edges: source, target, kind, walked both ways; seeds: query, node; members: node, community (one row a node).
    A node's weight is the best product of edge weights on a way of at most ``depth`` (0 to 2) steps, hops the length of its
    shortest way, seed the one its best way begins at (fewer steps, then the smaller seed, among equals). Of each
    query the ``most`` nodes of greatest weight (then fewer hops, then smaller id), seeds included, are kept; seeds are not
    returned. score: weight / (1 + hops), and 0.5 more if node and seed share a community.

    Each step joins on a node and keeps of each query the best way to each node at once: what goes on from a node goes on best
    from its best way, as products of different weights of ``REACH`` with one weight differ. No weight passes 1, so seeds come first, ways
    through another seed are no better than those that begin there, and a query with ``most`` seeds has no other node. A way whose weight lies
    below that of ``most`` nodes known of its query is not walked further. None of this changes a result.
    Rows with null query, ends or kinds of no weight take no part; repeated rows count once.
    """
    if not 0 <= depth <= 2:
        raise ValueError("depth must be from 0 to 2")
    one = edges.select("source", "target", weight_of(F.col("kind"), REACH).alias("w")).where("source is not null and target is not null and source <> target and w is not null")
    step = one.unionByName(one.select(F.col("target").alias("source"), F.col("source").alias("target"), "w"))
    starts = seeds.where("query is not null and node is not null").select("query", "node").distinct()
    starts = starts.join(starts.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") < most), "query", "left_semi")
    ways = starts.select("query", "node", F.col("node").alias("seed"), F.lit(0).alias("hops"), F.lit(1.0).alias("weight"))
    edge_of = ways.withColumn("__least", F.lit(0.0))
    for hop in range(1, depth + 1):
        out = edge_of.join(step, F.col("node") == F.col("source")).withColumn("weight", F.col("weight") * F.col("w")).where(F.col("weight") >= F.col("__least"))
        best = out.groupBy("query", F.col("target").alias("node")).agg(F.min(F.struct((-F.col("weight")).alias("w"), "seed")).alias("b"))
        best = best.join(starts, ["query", "node"], "left_anti").select("query", "node", F.col("b.seed").alias("seed"), F.lit(hop).alias("hops"), (-F.col("b.w")).alias("weight"))
        if hop < depth:
            best = _cut(best)
        ways = ways.unionByName(best)
        if hop < depth:  # weights are few: what is ranked is a row a query and weight
            levels = ways.groupBy("query", "weight").agg(F.count("*").alias("n"))
            least = levels.withColumn("n", F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("weight")))).where(F.col("n") >= most).groupBy("query").agg(F.max("weight").alias("__least"))
            edge_of = best.join(least, "query", "left").withColumn("__least", F.coalesce("__least", F.lit(0.0))).where(F.col("weight") >= F.col("__least"))
    best = F.min(F.struct((-F.col("weight")).alias("w"), "hops", "seed"))
    found = ways.groupBy("query", "node").agg(best.alias("b"), F.min("hops").alias("hops"))
    found = found.select("query", "node", F.col("b.seed").alias("seed"), "hops", (-F.col("b.w")).alias("weight"))
    order = Window.partitionBy("query").orderBy(F.desc("weight"), "hops", "node")
    kept = found.withColumn("__r", F.row_number().over(order)).where((F.col("__r") <= most) & (F.col("hops") > 0)).drop("__r")
    own = members.select("node", F.col("community").alias("__own"))
    theirs = members.select(F.col("node").alias("seed"), F.col("community").alias("__seed"))
    same = F.when(F.col("__own") == F.col("__seed"), SAME_COMMUNITY).otherwise(0.0)
    return kept.join(own, "node", "left").join(theirs, "seed", "left").select("query", "node", "seed", "hops", "weight", (F.col("weight") / (1 + F.col("hops")) + same).alias("score"))


def _between(links: DataFrame, where: DataFrame) -> DataFrame:
    """a, b (a < b), w: the weight between each two communities that an edge joins."""
    rows = links.join(where.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(where.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    return rows.where("ca <> cb").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))


def _sizes(where: DataFrame) -> DataFrame:
    return where.groupBy("community").agg(F.count("*").alias("n"))


def _merged(links: DataFrame, where: DataFrame, resolution: float, tolerance: float) -> DataFrame:
    """Communities joined two by two, where each is the other's best partner, until no joining raises the quality."""
    between = _cut(_between(links, where))
    while True:
        sizes = _sizes(where)
        at = lambda c: sizes.select(F.col("community").alias(c), F.col("n").alias(f"n{c}"))
        gains = between.join(at("a"), "a").join(at("b"), "b").select("a", "b", (F.col("w") - resolution * F.col("na") * F.col("nb")).alias("gain")).where(F.col("gain") > tolerance)
        sides = gains.select(F.explode(F.array("a", "b")).alias("side"), F.struct((-F.col("gain")).alias("g"), "a", "b").alias("pair"))
        best = sides.groupBy("side").agg(F.min("pair").alias("pair"))
        pairs = _cut(best.groupBy("pair").agg(F.count("*").alias("k")).where("k = 2").select(F.col("pair.a").alias("to"), F.col("pair.b").alias("community")))
        if pairs.isEmpty():
            return where
        where = _cut(where.join(pairs, "community", "left").select("node", F.coalesce("to", "community").alias("community")))
        name = lambda c: pairs.select(F.col("community").alias(c), F.col("to").alias(f"to{c}"))
        to = lambda c: F.coalesce(f"to{c}", c)
        renamed = between.join(name("a"), "a", "left").join(name("b"), "b", "left").select(to("a").alias("x"), to("b").alias("y"), "w").where("x <> y")
        between = _cut(renamed.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")))


def _moved(links: DataFrame, where: DataFrame, resolution: float, tolerance: float) -> tuple[DataFrame, bool]:
    """Single nodes moved, round by round, until no move raises the quality.

    Each round a hash deals communities into givers and takers, so that none does both. A giver's node asks for the taker
    that gains most; askers rank by gain in their giver and in their taker, and each loses the resolution for every asker
    ranked before it in either, the most their going together can cost. Those that still gain move; the first always does.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    moved, turn = False, 0
    while True:
        pull = both.join(where.select(F.col("node").alias("b"), F.col("community").alias("to")), "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("w").alias("w"))
        sizes = _sizes(where)
        held = where.join(sizes, "community").join(pull.select("node", F.col("to").alias("community"), F.col("w").alias("kept")), ["node", "community"], "left")
        rows = pull.join(held, "node").where("to <> community").join(sizes.select(F.col("community").alias("to"), F.col("n").alias("m")), "to")
        gain = F.col("w") - F.coalesce("kept", F.lit(0.0)) - resolution * (F.col("m") - F.col("n") + 1)
        rows = _cut(rows.select("node", "community", "to", gain.alias("gain")).where(F.col("gain") > tolerance))
        if rows.isEmpty():
            return where, moved
        moves = None
        while moves is None or moves.isEmpty():
            takes = lambda c: F.xxhash64(c, F.lit(turn)) % 2 == 0  # noqa: B023, E731
            asked = rows.where(~takes("community") & takes("to")).groupBy("node", "community").agg(F.min(F.struct((-F.col("gain")).alias("g"), "to")).alias("m"))
            asked = asked.select("node", "community", F.col("m.to").alias("to"), (-F.col("m.g")).alias("gain"))
            before = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("gain"), "node")) - 1
            costs = asked.withColumn("cost", resolution * (before("community") + before("to")))
            moves = _cut(costs.where(F.col("gain") - F.col("cost") > tolerance).select("node", "to"))
            turn += 1
        moved = True
        where = _cut(where.join(moves, "node", "left").select("node", F.coalesce("to", "community").alias("community")))


def _connected(links: DataFrame, where: DataFrame) -> DataFrame:
    """Communities cut into what hangs together, each named by its smallest node; this never lowers the quality.

    The smallest name spreads along edges inside communities and through each name's own name, so that rounds grow with
    the logarithm of the longest way.
    """
    at = lambda c: where.select(F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    inside = links.join(at("a"), "a").join(at("b"), "b").where("ca = cb").select("a", "b")
    inside = _cut(inside.unionByName(inside.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    names = _cut(where.select("node", F.col("node").alias("name")))
    while True:
        heard = inside.join(names.select(F.col("node").alias("b"), "name"), "b").groupBy(F.col("a").alias("node")).agg(F.min("name").alias("heard"))
        new = names.join(heard, "node", "left").select("node", "name", F.least("name", F.coalesce("heard", F.col("name"))).alias("low"))
        # a name that hears of a smaller one takes all who bear it along
        hooked = _cut(new.groupBy("name").agg(F.min("low").alias("low")))
        names = _cut(new.drop("low").join(hooked, "name").select("node", F.col("low").alias("name"), F.col("name").alias("old")))
        if names.where("name <> old").isEmpty():
            return names.select("node", F.col("name").alias("community"))
        names = names.drop("old")


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 0.05, tolerance: float = 1e-6, least: int = 1) -> DataFrame:
    """node, community (its smallest node): a partition of high quality under the constant Potts model, edges undirected.

    nodes: node; edges: source, target, weight. The quality is the weight of edges inside communities less ``resolution`` times
    the pairs of nodes inside. Three steps repeat until none raises it: communities that are each other's best partner join;
    single nodes move; what then no longer hangs together is cut. Each step can only raise the quality, so they end; every community is connected; ties go to smaller
    ids, so that the result depends on the graph alone. At last communities of fewer than ``least`` nodes join their strongest
    neighbour (then the smaller), should they have one.

    Rounds grow with the size of communities, which the resolution bounds, and on dense graphs with the moves each of them
    must make one after another, not with the number of nodes; each is joins and grouping on keys, cut by a checkpoint. A node that very many edges meet is added up on the way into its group.
    Null ends, loops, weights null or not above zero and ends that are no node take no part; repeated edges add up.
    """
    where = _cut(nodes.where("node is not null").select("node").distinct().withColumn("community", F.col("node")))
    known = lambda c: where.select(F.col("node").alias(c))
    links = edges.where("source <> target and weight > 0").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").cast("double").alias("w"))
    links = _cut(links.join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi"))
    while True:
        where = _merged(links, where, resolution, tolerance)
        where, moved = _moved(links, where, resolution, tolerance)
        if not moved:
            break
        where = _connected(links, where)
    if least > 1:
        small = _sizes(where).where(F.col("n") < least).select("community")
        between = _between(links, where)
        either = between.unionByName(between.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        pick = either.join(small.select(F.col("community").alias("a")), "a", "left_semi").groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("w"), "b")).alias("p")).select("a", F.col("p.b").alias("b"))
        top = _cut(_sizes(where).select(F.col("community").alias("node"), F.lit(0).alias("community")))
        names = _connected(_cut(pick), top).select(F.col("node").alias("community"), F.col("community").alias("name"))
        where = where.join(names, "community").select("node", F.col("name").alias("community"))
    return _named(where)


def _named(where: DataFrame) -> DataFrame:
    """Communities by their smallest node."""
    low = where.groupBy("community").agg(F.min("node").alias("low"))
    return where.join(low, "community").select("node", F.col("low").alias("community"))


def quality(edges: DataFrame, where: DataFrame, resolution: float = 0.05) -> DataFrame:
    """One row: quality of a partition (node, community) under the constant Potts model; 0 if there is none."""
    at = lambda c, k: where.select(F.col("node").alias(c), F.col("community").alias(k))
    inside = edges.where("source <> target and weight > 0").join(at("source", "ca"), "source").join(at("target", "cb"), "target").where("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    pairs = _sizes(where).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("pairs"))
    return inside.unionByName(pairs.select((-resolution * F.col("pairs")).alias("w"))).agg(F.sum("w").alias("quality"))
