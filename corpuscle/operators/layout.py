"""Places of nodes on a canvas, and the clusters that services are put into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.operators.graph import ancestors

#: Gaps between nodes, insets of containers, and size and offset of an added cluster.
GAP_X, GAP_Y = 46, 56
TOP, RIGHT, BOTTOM, LEFT = 62, 26, 26, 26
CLUSTER_WIDTH, CLUSTER_HEIGHT, SERVICE_X, SERVICE_Y = 240, 160, 20, 48


def columns_for(count: Column, most: int = 3) -> Column:
    """Columns of a grid of some siblings: roughly square, and not more than ``most``."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.sqrt(count)))).cast("int")


def grid(items: DataFrame, group: str, order: str, width: str, height: str, most: int = 3) -> DataFrame:
    """Items with x and y in their group's grid: columns as wide as their widest item, rows as tall as their tallest.

    Places come from running sums over columns and rows, which are fewer than items; items are numbered in order.
    """
    by = Window.partitionBy(group)
    n = columns_for(F.count("*").over(by), most)
    at = items.withColumn("__k", F.row_number().over(by.orderBy(order)) - 1).withColumn("__n", n)
    at = at.withColumns({"__c": F.col("__k") % F.col("__n"), "__r": F.floor(F.col("__k") / F.col("__n"))})
    before = lambda c: Window.partitionBy(group).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c, size, gap: at.groupBy(group, c).agg(F.max(size).alias("__s")).select(group, c, F.coalesce(F.sum(F.col("__s") + gap).over(before(c)), F.lit(0)).alias("x" if c == "__c" else "y"))
    return at.join(start("__c", width, GAP_X), [group, "__c"]).join(start("__r", height, GAP_Y), [group, "__r"]).drop("__k", "__n", "__c", "__r")


def contained(placed: DataFrame, group: str, width: str, height: str, least_width: int = 0, least_height: int = 0) -> DataFrame:
    """group, width and height of the container round each group's placed items."""
    right, below = F.max(F.col("x") + F.col(width)) + LEFT + RIGHT, F.max(F.col("y") + F.col(height)) + TOP + BOTTOM
    return placed.groupBy(group).agg(F.greatest(right, F.lit(least_width)).alias("width"), F.greatest(below, F.lit(least_height)).alias("height"))


def stacked(blocks: DataFrame, within: str, order: str, height: str) -> DataFrame:
    """Blocks with y, one under another within their container."""
    above = Window.partitionBy(within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("y", F.coalesce(F.sum(F.col(height) + GAP_Y).over(above), F.lit(0)))


def with_clusters(nodes: DataFrame) -> DataFrame:
    """Nodes, each service without a cluster above it in one of its own, which takes its place and parent.

    nodes: id, kind, name, parent (texts), x, y. Returns these with width and height, of added clusters alone.
    A service inside an added cluster is placed from its origin.
    """
    up = ancestors(nodes, "id", "parent")
    clusters = nodes.where("kind = 'ecs_cluster'").select(F.col("id").alias("ancestor"))
    inside = up.join(clusters, "ancestor", "left_semi").select(F.col("node").alias("id")).distinct().withColumn("held", F.lit(True))
    rows = nodes.select("id", "kind", "name", "parent", "x", "y").join(inside, "id", "left")
    alone = F.coalesce((F.col("kind") == "ecs_service") & F.col("held").isNull(), F.lit(False))
    none = F.lit(None).cast("int")
    node = lambda id_, kind, name, parent, x, y, w, h: F.struct(id_.alias("id"), kind.alias("kind"), name.alias("name"), parent.alias("parent"), x.cast("int").alias("x"), y.cast("int").alias("y"), w.alias("width"), h.alias("height"))
    c = F.col
    x, y, own = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)), F.concat("id", F.lit("-cluster"))
    pair = F.array(
        node(own, F.lit("ecs_cluster"), F.concat("name", F.lit(" cluster")), c("parent"), x, y, F.lit(CLUSTER_WIDTH), F.lit(CLUSTER_HEIGHT)),
        node(c("id"), c("kind"), c("name"), own, F.lit(SERVICE_X), F.lit(SERVICE_Y), none, none))
    same = F.array(node(c("id"), c("kind"), c("name"), c("parent"), c("x"), c("y"), none, none))
    return rows.select(F.explode(F.when(alone, pair).otherwise(same)).alias("n")).select("n.*")
