"""Graph and tree queries."""

from pyspark.sql import functions as F

from corpuscle.operators import communities, graph
from corpuscle.plans.base import query, table

#: Places as a tree: region <- nation <- customer.
_TREE = "(SELECT 'r' || r_regionkey AS id, NULL AS parent, 'region' AS kind, 1 AS w FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation', 2 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'customer', 4 FROM customer)"


def _tree(spark, d):
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("region").alias("kind"), F.lit(1).alias("w"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit("nation").alias("kind"), F.lit(2).alias("w"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.lit("customer").alias("kind"), F.lit(4).alias("w"))
    return r.unionByName(n).unionByName(c)


@query("""WITH RECURSIVE e AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT 's1' AS node, 0 AS hops UNION SELECT s.b, r.hops + 1 FROM r JOIN s ON r.node = s.a WHERE r.hops < 2) SELECT node, min(hops)::INT AS hops FROM r GROUP BY 1""")
def g1_neighbourhood(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    return graph.neighbourhood(e, spark.createDataFrame([("s1",)], "n string"), "n", 2, "a", "b")


@query(f"""WITH RECURSIVE t AS {_TREE}, c AS (SELECT id AS node, parent AS ancestor, 1 AS hops FROM t WHERE parent IS NOT NULL UNION ALL SELECT c.node, t.parent, c.hops + 1 FROM c JOIN t ON c.ancestor = t.id WHERE t.parent IS NOT NULL) SELECT node, ancestor, hops::INT AS hops FROM c""")
def g2_ancestors(spark, d):
    return graph.ancestors(_tree(spark, d), "id", "parent")


@query("SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS nation, 'r' || n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, NULL, 'r' || n_regionkey FROM nation")
def g3_g4_placement(spark, d):
    tree = _tree(spark, d)
    kinds = tree.select(F.col("id").alias("ancestor"), "kind")
    return graph.nearest_of(graph.ancestors(tree, "id", "parent"), kinds, ["nation", "region"])


@query("SELECT id, (CASE kind WHEN 'region' THEN 0 WHEN 'nation' THEN 1 ELSE 2 END)::INT AS depth, (CASE kind WHEN 'region' THEN 1 WHEN 'nation' THEN 3 ELSE 7 END)::BIGINT AS w FROM " + _TREE)
def g5_summed_up(spark, d):
    return graph.summed_up(_tree(spark, d), "id", "parent", ["w"])


@query("SELECT 'r' || n_regionkey AS node, count(*) AS below FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 0")
def g6_descendants(spark, d):
    found = graph.descendants(_tree(spark, d), "id", "parent").where("node like 'r%'")
    nations = found.where("descendant like 'c%'").unionByName(found.where("descendant like 'n%'").join(_tree(spark, d).where("kind = 'customer'").select(F.col("parent").alias("descendant")).distinct(), "descendant", "left_anti").select("node", "descendant", "hops"))
    return nations.groupBy("node").agg(F.count("*").alias("below"))


#: Each customer names another of a ring of eight, or one of no ring; some name none.
_RINGS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 16 < 8 THEN (c_custkey // 8) * 8 + (c_custkey + 1) % 8 WHEN c_custkey % 16 < 14 THEN c_custkey - 8 END AS parent FROM customer"


@query(f"WITH RECURSIVE t AS ({_RINGS}), up AS (SELECT id AS node, parent AS top, 1 AS n FROM t WHERE parent IS NOT NULL UNION ALL SELECT up.node, t.parent, n + 1 FROM up JOIN t ON t.id = up.top WHERE t.parent IS NOT NULL AND n < 10) SELECT DISTINCT node FROM up WHERE top = node")
def g7_cycles(spark, d):
    return graph.in_cycle(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), _ring_parent().alias("parent")), "id", "parent")


def _ring_parent():
    k = F.col("c_custkey")
    return F.when(k % 16 < 8, F.floor(k / 8) * 8 + (k + 1) % 8).when(k % 16 < 14, k - 8)


@query(f"SELECT id, (CASE kind WHEN 'region' THEN 0 WHEN 'nation' THEN 1 ELSE 2 END)::INT AS depth FROM {_TREE}")
def k8_parents_first(spark, d):
    return graph.parents_first(_tree(spark, d), "id", "parent", "id").select("id", "depth")


_FAULTS = """n AS (SELECT c_custkey // 2 * CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 2 END AS id, CASE WHEN c_nationkey % 5 = 0 THEN -1 WHEN c_custkey % 2 = 0 AND c_custkey % 7 <> 0 AND c_custkey > 2 THEN (c_custkey // 2 - 1) * 2 END AS parent, c_custkey AS pos FROM customer),
e AS (SELECT o_orderkey // 2 AS id, o_custkey // 2 * 2 AS source, o_custkey // 3 * 2 AS target, o_orderkey AS pos FROM orders), k AS (SELECT DISTINCT id FROM n)"""


@query(f"""WITH RECURSIVE {_FAULTS}, up AS (SELECT DISTINCT id AS node, parent AS top, 1 AS h FROM n WHERE parent IS NOT NULL UNION SELECT up.node, n.parent, h + 1 FROM up JOIN n ON n.id = up.top WHERE n.parent IS NOT NULL AND h < 3)
SELECT '/nodes/' || pos || '/id' AS pointer, 'repeated node id' AS message FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) > 1 UNION ALL SELECT '/edges/' || pos || '/id', 'repeated edge id' FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) > 1
UNION ALL SELECT '/edges/' || pos || '/source', 'unknown node' FROM e WHERE source NOT IN (FROM k) UNION ALL SELECT '/edges/' || pos || '/target', 'unknown node' FROM e WHERE target NOT IN (FROM k) UNION ALL SELECT '/nodes/' || pos || '/parent', 'unknown parent' FROM n WHERE parent IS NOT NULL AND parent NOT IN (FROM k)
UNION ALL SELECT '/edges/' || pos, 'edge from a node to itself' FROM e WHERE source = target UNION ALL SELECT '/nodes/' || pos || '/parent', 'parent cycle' FROM n WHERE id IN (SELECT node FROM up WHERE top = node)""")
def d1_problems(spark, d):
    k, half = F.col("c_custkey"), F.floor(F.col("c_custkey") / 2)
    parent = F.when(F.col("c_nationkey") % 5 == 0, -1).when((k % 2 == 0) & (k % 7 != 0) & (k > 2), (half - 1) * 2)
    nodes = table(spark, d, "customer").select((half * F.when(k % 7 == 0, 1).otherwise(2)).alias("id"), parent.alias("parent"), k.alias("pos"))
    of = lambda c, n: F.floor(F.col(c) / n)
    edges = table(spark, d, "orders").select(of("o_orderkey", 2).alias("id"), (of("o_custkey", 2) * 2).alias("source"), (of("o_custkey", 3) * 2).alias("target"), F.col("o_orderkey").alias("pos"))
    return graph.problems(nodes, edges)


@query("SELECT l_suppkey AS node, min(l_linenumber) AS hops, max(l_quantity) AS weight FROM lineitem GROUP BY 1")
def a22_best_reach(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.min("l_linenumber").alias("hops"), F.max("l_quantity").alias("weight"))


_KINDS = list(communities.REACH)
_KINDS_SQL = f"{_KINDS}[l_linenumber % 8 + 1]"
_REACH_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in communities.REACH.items()) + " END"


def _supply(spark, d):
    """Parts and suppliers of all order lines, the line number telling the kind of edge."""
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("l_linenumber") % 8).cast("int"))
    return table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), kind.alias("kind"))


@query(f"""WITH k AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, {_KINDS_SQL} AS kind FROM lineitem), o AS (SELECT a, b, max({_REACH_SQL}) AS w FROM k GROUP BY ALL), e AS (SELECT a, b, w FROM o UNION ALL SELECT b, a, w FROM o),
q AS (SELECT DISTINCT s_nationkey AS query, 's' || s_suppkey AS seed FROM supplier), h1 AS (SELECT query, seed, b AS node, 1 AS hops, w AS weight FROM q JOIN e ON a = seed),
h2 AS (SELECT query, seed, b AS node, 2 AS hops, max(weight * w) AS weight FROM h1 JOIN e ON a = node WHERE b <> seed GROUP BY ALL), ways AS (SELECT query, seed, seed AS node, 0 AS hops, 1.0::DOUBLE AS weight FROM q UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2),
f AS (SELECT query, node, first(seed ORDER BY weight DESC, hops, seed) AS seed, min(hops) AS hops, max(weight) AS weight FROM ways GROUP BY query, node), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY weight DESC, hops, node) AS r FROM f),
m AS (SELECT 's' || s_suppkey AS node, s_nationkey % 5 AS c FROM supplier UNION ALL SELECT 'p' || p_partkey, p_partkey % 5 FROM part)
SELECT query, r.node, seed, hops::INT AS hops, round(weight, 6) AS weight, round(weight / (1 + hops) + CASE WHEN a.c = b.c THEN 0.5 ELSE 0 END, 6) AS score FROM r LEFT JOIN m a ON a.node = r.node LEFT JOIN m b ON b.node = seed WHERE r <= 200 AND hops > 0""")
def g10_expanded(spark, d):
    s = table(spark, d, "supplier")
    member = lambda df, p, k, c: df.select(F.concat(F.lit(p), k).alias("node"), (F.col(c) % 5).alias("community"))
    members = member(s, "s", "s_suppkey", "s_nationkey").unionByName(member(table(spark, d, "part"), "p", "p_partkey", "p_partkey"))
    found = communities.expanded(_supply(spark, d), s.select(F.col("s_nationkey").alias("query"), F.concat(F.lit("s"), "s_suppkey").alias("node")), members)
    return found.withColumns({"weight": F.round("weight", 6), "score": F.round("score", 6)})


@query()
def g11_communities(spark, d):
    named = table(spark, d, "customer").select(F.col("c_custkey").alias("source"), _ring_parent().alias("target"), F.get(F.array(*map(F.lit, _KINDS)), (F.col("c_custkey") % 8).cast("int")).alias("kind"))
    weighted = named.withColumn("weight", communities.weight_of(F.col("kind"), communities.TOGETHER, communities.GUESSED))
    return communities.communities(named.select(F.col("source").alias("node")), weighted)
