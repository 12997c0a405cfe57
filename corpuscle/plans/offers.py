"""Price offers, limits, layout, generated code and message segments."""

from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators import layout, predict, prices
from corpuscle.operators import relational as r
from corpuscle.plans.base import query, table
from corpuscle.streaming import events


def _pick(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


# -- price offers: parts as products, order lines as their terms

_REGIONS = ["us-east-1", "eu-west-1"]
_SLICES = [
    prices.Slice(("ec2", "ec2-spot"), ("Compute Instance",)),
    prices.Slice(("rds",), ("Database Instance",), {"databaseEngine": ("PostgreSQL", "MySQL", "MariaDB")}),
    prices.Slice(("ebs",), (), {"volumeApiName": ("gp3",), "currentGeneration": ("Yes",)}),
]

_PRODUCTS = """WITH p AS (SELECT 'p' || p_partkey AS sku, ['Compute Instance', 'Database Instance', 'Storage', 'Other'][p_partkey % 4 + 1] AS family, ['us-east-1', 'eu-west-1', 'mars'][p_size % 3 + 1] AS region,
CASE WHEN p_size % 5 = 0 THEN 'No' ELSE 'Yes' END AS current, CASE WHEN p_size % 7 = 0 THEN 'x-ExtendedSupport' ELSE 'usage-' || p_brand END AS usage_type, CASE WHEN (p_partkey // 4) % 2 = 0 THEN 'PostgreSQL' ELSE 'Oracle' END AS engine,
CASE WHEN p_size % 2 = 0 THEN 'NA' ELSE p_size || ' GiB' END AS memory, p_type AS type, CASE WHEN p_partkey % 3 = 0 THEN 'gp2' ELSE 'gp3' END AS volume FROM part),
k AS (SELECT *, CASE WHEN family = 'Compute Instance' THEN ['ec2', 'ec2-spot'] WHEN family = 'Database Instance' AND engine = 'PostgreSQL' THEN ['rds'] WHEN volume = 'gp3' THEN ['ebs'] END AS services,
concat_ws(';', 'databaseEngine=' || engine, 'instanceType=' || type, CASE WHEN memory <> 'NA' THEN 'memory=' || memory END, 'storageClass=' || volume) AS kept FROM p),
o AS (SELECT * FROM k WHERE region <> 'mars' AND current = 'Yes' AND usage_type <> 'x-ExtendedSupport' AND services IS NOT NULL) """


def _products(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    a = {
        "regionCode": _pick([*_REGIONS, "mars"], s), "currentGeneration": F.when(s % 5 == 0, "No").otherwise("Yes"),
        "usagetype": F.when(s % 7 == 0, "x-ExtendedSupport").otherwise(F.concat(F.lit("usage-"), "p_brand")), "databaseEngine": _pick(["PostgreSQL", "Oracle"], F.floor(k / 4)),
        "memory": F.when(s % 2 == 0, "NA").otherwise(F.concat(s.cast("string"), F.lit(" GiB"))), "instanceType": F.col("p_type"), "volumeApiName": F.when(k % 3 == 0, "gp2").otherwise("gp3"),
    }
    family = _pick(["Compute Instance", "Database Instance", "Storage", "Other"], k)
    return table(spark, d, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("sku"), family.alias("family"), F.create_map(*(x for n, v in a.items() for x in (F.lit(n), v))).alias("attributes"))


def _kept(attributes):
    return F.array_join(F.array_sort(F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("kept")


@query(_PRODUCTS + "SELECT sku, region, array_to_string(services, ',') AS services, usage_type FROM o")
def f11_offered_products(spark, d):
    return prices.offered_products(_products(spark, d), _SLICES, _REGIONS).select("sku", "region", F.array_join("services", ",").alias("services"), "usage_type")


@query(_PRODUCTS + "SELECT sku, kept FROM k")
def f12_whitelisted(spark, d):
    return _products(spark, d).select("sku", _kept(prices.whitelisted(F.col("attributes"))))


@query(_PRODUCTS + """, t AS (SELECT 'p' || l_partkey AS sku, CASE l_returnflag WHEN 'R' THEN 'Hrs' WHEN 'A' THEN 'GB-Mo' END AS unit, l_extendedprice AS usd FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey::VARCHAR, l_linenumber, l_returnflag, l_extendedprice) = 1)
SELECT unnest(services) AS service, region, sku, usage_type, unit, usd, kept FROM o JOIN t USING (sku) WHERE unit IS NOT NULL""")  # fmt: skip
def d21_price_rates(spark, d):
    unit = F.when(F.col("l_returnflag") == "R", "Hours").when(F.col("l_returnflag") == "A", "GB-Month").otherwise("Quantity")
    terms = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("sku"), F.col("l_orderkey").alias("term"), F.col("l_linenumber").alias("begin"), unit.alias("unit"), F.col("l_extendedprice").alias("usd"), "l_returnflag")
    rates = prices.price_rates(_products(spark, d), terms, _SLICES, _REGIONS)
    return rates.select("service", "region", "sku", "usage_type", "unit", "usd", _kept(F.col("attributes")))


# -- assumptions, evidence, limits


@query("""WITH e AS (SELECT o_custkey, o_orderpriority AS id, arg_max(round(o_totalprice * 100)::BIGINT, o_orderkey) AS cents FROM orders GROUP BY 1, 2),
g AS (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS gaps FROM orders GROUP BY 1)
SELECT o_custkey, string_agg(id || '=' || cents, ',' ORDER BY id) AS assumptions, any_value(gaps) AS gaps FROM e JOIN g USING (o_custkey) GROUP BY 1""")
def a18_assumptions(spark, d):
    orders = table(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    rows = r.assumption_union(orders, ["o_custkey"], "o_orderpriority", "o_orderkey", "cents", "o_orderstatus")
    joined = F.array_join(F.transform("assumptions", lambda a: F.concat(a["o_orderpriority"], F.lit("="), a["cents"].cast("string"))), ",")
    return rows.select("o_custkey", joined.alias("assumptions"), F.array_join("gaps", ",").alias("gaps"))


@query("""SELECT p_brand, CASE WHEN p_size < 10 THEN 'small' WHEN p_partkey % 4 = 0 THEN 'fourth' WHEN p_retailprice < 1200 THEN 'cheap' END AS rule, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS evidence
FROM part GROUP BY 1, 2 HAVING rule IS NOT NULL""")
def a19_evidence(spark, d):
    rules = {"small": F.col("p_size") < 10, "fourth": F.col("p_partkey") % 4 == 0, "cheap": F.col("p_retailprice") < 1200}
    return r.evidence(table(spark, d, "part"), ["p_brand"], rules, "p_type").withColumn("evidence", F.array_join("evidence", "|"))


@query("SELECT o_custkey, count(*) AS active FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1 HAVING count(*) > 1")
def v3_one_active(spark, d):
    return r.several_active(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["O", "P"])


_KINDS = ["ecs_service", "rds_instance", "vpc"]


@query("""SELECT p_partkey AS id, n_nationkey AS limit_id FROM part JOIN nation ON p_size % 4 = n_regionkey % 4
WHERE n_nationkey % 3 = 0 OR n_nationkey % 3 = 1 AND p_partkey % 3 = 1 OR n_nationkey % 3 = 2 AND p_partkey % 3 <> 1""")
def f15_applicable_limits(spark, d):
    resources = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("service"), _pick(_KINDS, F.col("p_partkey")).alias("kind"))
    n = F.col("n_nationkey") % 3
    applies = F.when(n == 1, F.array(F.lit("rds_instance"))).when(n == 2, F.array(F.lit("vpc"), F.lit("ecs_service")))
    limits = table(spark, d, "nation").select(F.col("n_nationkey").alias("limit_id"), (F.col("n_regionkey") % 4).alias("service"), applies.alias("applies"))
    return predict.applicable_limits(resources, limits).select("id", "limit_id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 9 IN (0, 4, 8)")
def f16_serving(spark, d):
    kinds = ["ecs_service", "vpc", "subnet", "security_group", "rds_instance", "iam_role", "internet_gateway", "cloudwatch_log_group", None]
    return predict.serving(table(spark, d, "part").select(F.col("p_partkey").alias("id"), _pick(kinds, F.col("p_partkey")).alias("kind"))).select("id")


@query("SELECT c_custkey, c_custkey % 300 <= 255 AND c_custkey % 5 <> 0 AND c_custkey % 40 <= 32 AS ok FROM customer")
def d2_cidr(spark, d):
    k = F.col("c_custkey")
    net = F.concat_ws(".", (k % 300).cast("string"), F.col("c_nationkey").cast("string"), (k % 7).cast("string"), F.when(k % 5 == 0, "01").otherwise("1"))
    return table(spark, d, "customer").select("c_custkey", text.is_cidr(F.concat_ws("/", net, (k % 40).cast("string"))).alias("ok"))


# -- layout


_GRID = """WITH i AS (SELECT p_brand, p_partkey, p_size + 10 AS w, p_size % 7 + 20 AS h, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, least(3, ceil(sqrt(count(*) OVER (PARTITION BY p_brand))))::INT AS n FROM part),
a AS (SELECT *, k % n AS c, k // n AS r FROM i),
cx AS (SELECT p_brand, c, coalesce(sum(max(w) + 46) OVER (PARTITION BY p_brand ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x FROM a GROUP BY 1, 2),
ry AS (SELECT p_brand, r, coalesce(sum(max(h) + 56) OVER (PARTITION BY p_brand ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS y FROM a GROUP BY 1, 2),
g AS (SELECT p_brand, p_partkey, x, y, w, h FROM a JOIN cx USING (p_brand, c) JOIN ry USING (p_brand, r)) """


def _grid(spark, d):
    items = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") + 10).alias("w"), (F.col("p_size") % 7 + 20).alias("h"))
    return layout.grid(items, "p_brand", "p_partkey", "w", "h")


@query(_GRID + "SELECT p_partkey, x, y FROM g")
def g9_grid(spark, d):
    return _grid(spark, d).select("p_partkey", "x", "y")


@query(_GRID + """, b AS (SELECT p_brand, greatest(max(x + w) + 52, 200)::BIGINT AS width, greatest(max(y + h) + 88, 150)::BIGINT AS height FROM g GROUP BY 1)
SELECT p_brand, width, height, coalesce(sum(height + 56) OVER (ORDER BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS y FROM b""")  # fmt: skip
def g9_containers(spark, d):
    boxes = layout.contained(_grid(spark, d), "p_brand", "w", "h", 200, 150).withColumn("canvas", F.lit(1))
    return layout.stacked(boxes, "canvas", "p_brand", "height").select("p_brand", "width", "height", "y")


@query("""WITH n AS (SELECT 'r' || r_regionkey AS id, 'vpc' AS kind, r_name AS name, NULL AS parent, 0 AS x, 0 AS y, NULL AS held FROM region
UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'ecs_cluster' ELSE 'subnet' END, n_name, 'r' || n_regionkey, n_nationkey, 1, NULL FROM nation
UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'rds_instance' ELSE 'ecs_service' END, c_name, 'n' || c_nationkey, (c_custkey % 100)::INT, NULL, c_nationkey % 2 = 0 OR c_custkey % 3 = 0 FROM customer)
SELECT id, kind, name, parent, x, y, NULL::INT AS width, NULL::INT AS height FROM n WHERE held IS NULL OR held
UNION ALL SELECT id, kind, name, id || '-cluster', 20, 48, NULL, NULL FROM n WHERE NOT held
UNION ALL SELECT id || '-cluster', 'ecs_cluster', name || ' cluster', parent, x, 0, 240, 160 FROM n WHERE NOT held""")
def g8_clusters(spark, d):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    node = lambda df, id_, kind, name, parent, x, y: df.select(id_.alias("id"), kind.alias("kind"), F.col(name).alias("name"), parent.cast("string").alias("parent"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    regions = node(table(spark, d, "region"), s("r", "r_regionkey"), F.lit("vpc"), "r_name", F.lit(None), F.lit(0), F.lit(0))
    nations = node(table(spark, d, "nation"), s("n", "n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, "ecs_cluster").otherwise("subnet"), "n_name", s("r", "n_regionkey"), F.col("n_nationkey"), F.lit(1))
    services = node(table(spark, d, "customer"), s("c", "c_custkey"), F.when(F.col("c_custkey") % 3 == 0, "rds_instance").otherwise("ecs_service"), "c_name", s("n", "c_nationkey"), F.col("c_custkey") % 100, F.lit(None))
    return layout.with_clusters(regions.unionByName(nations).unionByName(services))


# -- generated code, messages, order


@query("""SELECT p_partkey, concat_ws(chr(10), 'name = ' || to_json(p_name)::VARCHAR, 'size = ' || p_size, CASE WHEN p_size % 3 <> 0 THEN 'brand = ' || to_json(p_brand)::VARCHAR END, 'large = ' || CASE WHEN p_size > 20 THEN 'True' ELSE 'False' END) AS code FROM part""")
def s12_arguments(spark, d):
    s = F.col("p_size")
    properties = [("name", F.col("p_name"), "string", True), ("size", s, "number", True), ("brand", F.when(s % 3 == 0, "").otherwise(F.col("p_brand")), "string", False), ("large", s > 20, "boolean", False)]
    return table(spark, d, "part").select("p_partkey", text.arguments(properties, "python").alias("code"))


@query(r"""WITH m AS (SELECT doc_id, coalesce(text, '') || ' [file:a/' || doc_id || '.py] `x` ```py' || chr(10) || 'x = ' || doc_id || chr(10) || '``` [1]' AS t FROM documents),
p AS (SELECT doc_id, regexp_extract_all(t, '```[^\n`]*\n[\s\S]*?(?:\n```|\z)|```|`[^`\n]+`|\[(?:file|sku|prediction):[^\]]{1,200}\]|[^`\[]+|[`\[]') AS p FROM m)
SELECT doc_id, len(list_filter(p, lambda x: regexp_matches(x, '\A```[^\n`]*\n'))) AS blocks, len(list_filter(p, lambda x: regexp_matches(x, '\A`[^`\n]+`\z'))) AS codes,
len(list_filter(p, lambda x: regexp_matches(x, '\A\[(?:file|sku|prediction):'))) AS citations,
coalesce(list_sum(list_transform(list_filter(p, lambda x: NOT regexp_matches(x, '\A(```[^\n`]*\n|`[^`\n]+`\z|\[(?:file|sku|prediction):)')), lambda x: length(x))), 0)::BIGINT AS text_chars FROM p""")
def s15_segments(spark, d):
    i = F.col("doc_id").cast("string")
    message = F.concat(F.coalesce("text", F.lit("")), F.lit(" [file:a/"), i, F.lit(".py] `x` ```py\nx = "), i, F.lit("\n``` [1]"))
    rows = table(spark, d, "documents").select("doc_id", text.segments(message).alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    chars = F.aggregate(F.filter("s", lambda x: x["kind"] == "text"), F.lit(0).cast("long"), lambda n, x: n + F.length(x["value"]))
    return rows.select("doc_id", count("block").alias("blocks"), count("code").alias("codes"), count("citation").alias("citations"), chars.alias("text_chars"))


@query(r"""WITH f AS (SELECT doc_id, ['id: d' || doc_id || chr(10) || 'data: ' || regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g'), ': note', 'event: done'] AS f FROM documents)
SELECT doc_id, (unnest([1, 2, 3]) - 1)::INT AS place, md5(unnest(f)) AS digest FROM f""")
def src11_frames(spark, d):
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " ")
    sent = F.encode(F.concat(F.lit("id: d"), F.col("doc_id").cast("string"), F.lit("\ndata: "), flat, F.lit("\n\n: note\r\n\r\nevent: done\n\nevent: cut")), "UTF-8")
    rows = table(spark, d, "documents").select("doc_id", sent.alias("sent")).select("doc_id", "sent", F.explode(F.sequence(F.lit(1), F.length("sent"), F.lit(61))).alias("seq"))
    chunks = rows.select("doc_id", "seq", F.substring("sent", F.col("seq"), F.lit(61)).alias("chunk"))
    return events.frames_of_chunks(chunks, "doc_id", "seq", "chunk").select("doc_id", "place", F.md5("frame").alias("digest"))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey % 2 = 0, p_partkey) AS place FROM part""")
def k7_locale_order(spark, d):
    from pyspark.sql.window import Window

    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.lower("p_name"))
    order = Window.partitionBy("p_brand").orderBy(text.in_locale_order(name), "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(order).alias("place"))
