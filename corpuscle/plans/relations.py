"""Join, pick and set queries."""

from pyspark.sql import functions as F

from corpuscle.operators import relational as r
from corpuscle.plans.base import query, table


@query("SELECT l_orderkey, l_linenumber, o_orderdate, p_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48")
def j1_star_join(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 48")
    rows = li.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", "o_orderdate", "p_name")


@query("SELECT p_partkey, w[i] AS item, length(w[i])::INT AS qty, i::INT AS place FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part), unnest(range(1, len(w) + 1)) AS t(i)")
def j3_given_order(spark, d):
    words = F.split("p_type", " ")
    rows = table(spark, d, "part").select("p_partkey", words.alias("item"), F.transform(words, F.length).alias("qty"))
    return r.in_given_order(rows, "item", "qty").select("p_partkey", "item", "qty", "place")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1) ON c_custkey = o_custkey")
def j4_lateral_latest(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return r.attach_latest(table(spark, d, "customer").select("c_custkey"), done.select("c_custkey", "o_orderkey", "o_orderdate"), ["c_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).select("c_custkey", "o_orderkey")


@query("SELECT DISTINCT s, t FROM (SELECT l_partkey AS s, l_suppkey AS t FROM lineitem) WHERE s < 30 OR t < 3")
def j5_either_end(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("s"), F.col("l_suppkey").alias("t"))
    # one node table for each end: parts below 30, suppliers below 3
    a = r.either_end(edges, spark.range(0, 30).withColumnRenamed("id", "n"), "n", "s", "t").where("s < 30")
    return a.unionByName(r.either_end(edges, spark.range(0, 3).withColumnRenamed("id", "n"), "n", "s", "t").where("t < 3")).distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j6_semi(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 200000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_orderstatus = 'F'")
def j7_exists(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").limit(1).agg((F.count("*") > 0).alias("found"))


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def j12_lookup(spark, d):
    region = F.broadcast(table(spark, d, "region"))  # a dimension of fixed size
    return table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", "r_name")


_HOST = "regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"


@query(f"SELECT page_id, CASE WHEN {_HOST} LIKE '%/%/%' THEN regexp_extract({_HOST}, '^([^/]*/[^/]*)/', 1) ELSE regexp_extract({_HOST}, '^([^/]*)', 1) END AS prefix FROM pages")
def j13_longest_prefix(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("name"))
    parts = F.split("name", "/")
    known = pages.select(F.element_at(parts, 1).alias("prefix")).unionByName(pages.where(F.size(parts) > 2).select(F.array_join(F.slice(parts, 1, 2), "/").alias("prefix"))).distinct()
    return r.longest_prefix(pages, known, "name", "prefix").select("page_id", "prefix")


@query("""WITH q AS (SELECT p_partkey, p_brand, p_size FROM part), m AS (SELECT q.p_partkey, count(*) AS n, min(o.p_retailprice) AS price FROM q JOIN part o ON q.p_brand = o.p_brand AND q.p_size = o.p_size GROUP BY 1) SELECT q.p_partkey, m.price FROM q LEFT JOIN m ON q.p_partkey = m.p_partkey AND m.n = 1""")
def j14_only_match(spark, d):
    part = table(spark, d, "part")
    asked = part.select("p_partkey", "p_brand", "p_size")
    return r.only_match(asked, part.select("p_brand", "p_size", F.col("p_retailprice").alias("price")), ["p_brand", "p_size"], "p_partkey", ["price"]).select("p_partkey", "price")


@query(f"SELECT page_id, regexp_extract({_HOST}, '^([^/]*)', 1) AS owner FROM pages")
def j15_nearest_ancestor(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))
    owners = pages.select(F.element_at(F.split("path", "/"), 1).alias("owner")).unionByName(spark.createDataFrame([(".",)], "owner string"))
    return r.nearest_ancestor(pages, owners, "path", "owner").select("page_id", "owner")


@query("SELECT s_suppkey, l AS lim FROM supplier JOIN (SELECT unnest(['0', '1', '*']) AS k, unnest(['zero', 'one', 'all']) AS l) ON k = '*' OR k = (s_suppkey % 3)::VARCHAR")
def j16_wildcard(spark, d):
    limits = spark.createDataFrame([("0", "zero"), ("1", "one"), ("*", "all")], "k string, lim string")
    return r.wildcard_join(table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3).cast("string").alias("k")), limits, "k").select("s_suppkey", "lim")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def j17_dangling(spark, d):
    known = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    return r.dangling(table(spark, d, "lineitem"), "l_orderkey", known, "o_orderkey").select("l_orderkey", "l_linenumber")


@query("""SELECT DISTINCT c_custkey AS source, s_suppkey AS target, c_nationkey AS need FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey <> s_suppkey AND NOT (c_custkey % 5 = s_suppkey % 5)""")
def j18_offered(spark, d):
    needs = table(spark, d, "customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("need"))
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_nationkey").alias("offer"))
    group = F.col("source") % 5, F.col("target") % 5
    return r.offered(needs, nodes, group[0] == group[1], "need", "offer", "source", "target", group)


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(*) AS lines, bool_and(l_quantity > 5) AS all_big FROM lineitem GROUP BY 1")
def a3_drafts(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count("*").alias("lines"), F.every(F.col("l_quantity") > 5).alias("all_big"))


@query("SELECT l_orderkey, arg_min(l_shipdate, {'a': l_linenumber, 'b': l_shipdate}) AS l_shipdate, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS suppliers FROM lineitem GROUP BY 1")
def a5_merged(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_shipdate").alias("at"), "l_shipdate", F.array("l_suppkey").alias("suppliers"))
    out = r.merged(rows, "l_orderkey", "at", ["l_shipdate"], ["suppliers"])
    return out.withColumn("suppliers", F.array_join(F.col("suppliers").cast("array<string>"), ","))


@query("SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(l_partkey % 50)))::VARCHAR[], ',') AS peer_key FROM lineitem GROUP BY 1")
def a10_peer_key(spark, d):
    pad = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("p"))
    sets = pad.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("p")).alias("p"))
    return sets.select("l_suppkey", F.array_join(F.col("p").cast("array<string>"), ",").alias("peer_key"))


@query("SELECT n_regionkey, min_by(n_name, {'k': -n_nationkey, 'n': n_name}) AS last FROM nation GROUP BY 1")
def a11_arg_min(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.min_by("n_name", F.struct(-F.col("n_nationkey"), F.col("n_name"))).alias("last"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS declared, count(*) FILTER (o_orderstatus <> 'F') AS inferred FROM orders")
def a12_count_if(spark, d):
    return table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("declared"), F.count_if(F.col("o_orderstatus") != "F").alias("inferred"))


@query("SELECT r_name, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS names FROM region LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_regionkey = r_regionkey GROUP BY 1")
def a13_with_all(spark, d):
    rows = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    out = r.with_all(rows, table(spark, d, "region"), "r_regionkey", "n_name")
    return out.join(table(spark, d, "region"), "r_regionkey").select("r_name", F.array_join("n_name", ",").alias("names"))


@query("SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def a16_rate_dedup(spark, d):
    return r.first_of(table(spark, d, "part"), ["p_brand", "p_size"], "p_partkey").select("p_brand", "p_size", "p_partkey")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def w1_latest(spark, d):
    return r.latest(table(spark, d, "orders").where("o_orderstatus = 'F'"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def w2_newest_n(spark, d):
    return r.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS t, last_value(CASE WHEN event_id % 2 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM events")
def w3_coalescing_upsert(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("t"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("v"))
    return r.coalescing_upsert(rows, "user_id", "event_id", ["t", "v"])


@query("""WITH c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM s GROUP BY user_id, run, event_type""")
def w9_islands(spark, d):
    return r.islands(table(spark, d, "events"), ["user_id"], "event_id", "event_type")


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) > 1")
def w10_duplicates(spark, d):
    return r.duplicates(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey").select("o_orderkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
def k10_nulls_last(spark, d):
    return table(spark, d, "customer").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(25).select("c_custkey", "c_acctbal")


@query("SELECT l_orderkey, arg_min(l_extendedprice, {'a': l_returnflag, 'b': l_linenumber, 'c': l_extendedprice}) AS price FROM lineitem GROUP BY 1")
def k9_first_tier(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_extendedprice", F.struct("l_returnflag", "l_linenumber", "l_extendedprice")).alias("price"))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY len(string_split(CASE WHEN doc_id % 2 = 0 THEN 'a/b' ELSE 'c' END, '/')), doc_id) <= CASE source WHEN 'src0' THEN 5 WHEN 'src1' THEN 2 ELSE 0 END")
def k5_shallow_first(spark, d):
    from corpuscle.operators.manifest import shallow_first

    rows = table(spark, d, "documents").withColumn("p", F.when(F.col("doc_id") % 2 == 0, "a/b").otherwise("c"))
    return shallow_first(rows, "source", "p", "doc_id", {"src0": 5, "src1": 2}).select("source", "doc_id")


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def u2_union_all(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).unionByName(table(spark, d, "region").select(F.col("r_regionkey").alias("k")))


@query("SELECT k, min(src) AS src FROM (SELECT n_nationkey AS k, 'a' AS src FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'b' FROM nation) GROUP BY 1")
def u4_prefer(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return r.prefer(n.where("k % 2 = 0").withColumn("src", F.lit("a")), n.withColumn("src", F.lit("b")), ["k"])


@query("SELECT n_nationkey AS k, 'appeared' AS state FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT n_nationkey, 'resolved' FROM nation WHERE n_nationkey < 5 UNION ALL SELECT NULL, 'unchanged ' || count(*) FROM nation WHERE n_nationkey BETWEEN 5 AND 19")
def u5_delta(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return r.delta(n.where("k < 20"), n.where("k >= 5"))


@query("SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def v4_repeated_keys(spark, d):
    return r.repeated_keys(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


@query("""WITH b AS (SELECT s_suppkey AS box, (s_suppkey % 10) * 10.0 AS x0, (s_suppkey % 10) * 10.0 + 25 AS x1, s_suppkey AS depth FROM supplier) SELECT p_partkey, (SELECT arg_max(box, depth) FROM b WHERE p_size BETWEEN x0 AND x1) AS box FROM part""")
def f19_containers(spark, d):
    boxes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("box"), ((F.col("s_suppkey") % 10) * 10.0).alias("x0"), F.lit(0.0).alias("y0"), ((F.col("s_suppkey") % 10) * 10.0 + 25).alias("x1"), F.lit(1.0).alias("y1"), F.col("s_suppkey").alias("depth"))
    points = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.lit(0.5).alias("y"))
    return r.deepest_container(points, boxes, "p_partkey", "box", "depth", 20.0).select("p_partkey", "box")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, (a.n_regionkey = b.n_nationkey % 5 OR b.n_regionkey = a.n_nationkey % 5) AS legal FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def f18_legal_pairs(spark, d):
    n = table(spark, d, "nation")
    a = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("r"), F.array("n_regionkey").alias("aa"))
    b = n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("r"), F.array("n_regionkey").alias("bb"))
    mod = lambda c: (F.col(c) % 5).cast("int")
    return a.join(b, "r").select("a", "b", r.allowed_pair(mod("a"), mod("b"), F.col("aa"), F.col("bb")).alias("legal"))
