"""Cost, latency, capacity and availability queries."""

from pyspark.sql import functions as F

from corpuscle.functions import numeric, text
from corpuscle.operators import predict
from corpuscle.plans.base import query, table
from corpuscle.sources.files import rate_table

_RATES = {"postgres": {"db.m5.large": {"single-az": 0.178, "multi-az": 0.356}, "db.r5.large": {"single-az": 0.25}}, "mysql": {"db.m5.large": {"single-az": 0.171, "multi-az": 0.342}}}
_STORAGE = [("gp3", "single-az", 0.115), ("gp3", "multi-az", 0.23), ("io1", "single-az", 0.125)]


def _resources(spark, d):
    p = F.col("p_partkey")
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    return table(spark, d, "part").select(
        p.alias("id"), pick(["here", "here", "there"], p).alias("region"), pick(["postgres", "mysql"], p).alias("engine"), pick(["db.m5.large", "db.r5.large", "db.t9.huge"], p).alias("class"),
        pick(["single-az", "multi-az"], F.floor(p / 2)).alias("deployment"), pick(["gp3", "io1"], F.floor(p / 3)).alias("storage_type"), (p % 100 + 20).alias("storage_gb"), (p % 3).alias("backup_days"))


_COST = """WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 2 THEN 'there' ELSE 'here' END AS region, CASE p_partkey % 2 WHEN 0 THEN 'postgres' ELSE 'mysql' END AS engine, CASE p_partkey % 3 WHEN 0 THEN 'db.m5.large' WHEN 1 THEN 'db.r5.large' ELSE 'db.t9.huge' END AS class,
CASE (p_partkey // 2) % 2 WHEN 0 THEN 'single-az' ELSE 'multi-az' END AS deployment, CASE (p_partkey // 3) % 2 WHEN 0 THEN 'gp3' ELSE 'io1' END AS storage_type, p_partkey % 100 + 20 AS gb FROM part),
h AS (SELECT * FROM (VALUES ('postgres', 'db.m5.large', 'single-az', 0.178::DOUBLE), ('postgres', 'db.m5.large', 'multi-az', 0.356), ('postgres', 'db.r5.large', 'single-az', 0.25), ('mysql', 'db.m5.large', 'single-az', 0.171), ('mysql', 'db.m5.large', 'multi-az', 0.342)) AS t(engine, class, deployment, hour_usd)),
s AS (SELECT * FROM (VALUES ('gp3', 'single-az', 0.115::DOUBLE), ('gp3', 'multi-az', 0.23), ('io1', 'single-az', 0.125)) AS t(storage_type, deployment, gb_usd)),
c AS (SELECT id, region, CASE WHEN region = 'here' THEN floor((coalesce(floor(hour_usd * 730.0 * 100 + 0.5) / 100, 0) + coalesce(floor(gb_usd * gb * 100 + 0.5) / 100, 0)) * 100 + 0.5) / 100 ELSE 0.0 END AS monthly_usd FROM r LEFT JOIN h USING (engine, class, deployment) LEFT JOIN s USING (storage_type, deployment)) """


def _costs(spark, d):
    storage = spark.createDataFrame(_STORAGE, "storage_type string, deployment string, gb_usd double")
    return predict.resource_cost(_resources(spark, d), rate_table(spark, _RATES), storage, 730.0, "here")


@query(_COST + "SELECT id, monthly_usd FROM c")
def d10_resource_cost(spark, d):
    return _costs(spark, d).select("id", "monthly_usd")


@query(_COST + "SELECT region, sum(floor(monthly_usd * 100 + 0.5)::BIGINT) / 100.0::DOUBLE AS total_usd, count(*) AS items FROM c GROUP BY 1")
def a6_roll_up(spark, d):
    return predict.roll_up(_costs(spark, d).join(_resources(spark, d).select("id", "region"), "id"), ["region"], "monthly_usd")


@query("SELECT p_partkey AS id, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['hours'] ELSE ['gb', 'hours'] END) AS assumption FROM part")
def d11_sensitivity(spark, d):
    rows = table(spark, d, "part")
    cost = lambda a: a["hours"] * 0.2 + F.when(F.col("p_partkey") % 2 == 1, a["gb"] * 0.1).otherwise(0.0)
    return predict.sensitivity(rows.withColumnRenamed("p_partkey", "id").withColumn("p_partkey", F.col("id")), "id", cost, {"hours": 730.0, "gb": 100.0, "requests": 1e6})


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS usd, p_partkey % 4 = 0 AS fresh FROM part")
def d12_revise(spark, d):
    base = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("usd"))
    return predict.revise(base, base.where("id % 4 = 0").select("id"), "id", base.withColumn("usd", F.col("usd") * 2))


_LOAD = "SELECT p_partkey AS id, p_size AS service_ms, p_retailprice / 20 AS rps, (p_partkey % 8 + 1)::INT AS c FROM part"


def _load(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("service_ms"), (F.col("p_retailprice") / 20).alias("arrival_rps"), (F.col("p_partkey") % 8 + 1).cast("int").alias("servers"))


_ERLANG = f"""WITH RECURSIVE l AS ({_LOAD}), u AS (SELECT id, service_ms, c, least(rps / (c * 1000.0 / service_ms), 0.95) AS rho, rps / (c * 1000.0 / service_ms) AS raw FROM l),
b AS (SELECT id, 0 AS n, 1.0::DOUBLE AS b FROM u UNION ALL SELECT b.id, b.n + 1, (c * rho * b.b) / (b.n + 1 + c * rho * b.b) FROM b JOIN u USING (id) WHERE b.n < c),
q AS (SELECT u.*, b.b / (1 - rho * (1 - b.b)) AS wait FROM u JOIN b ON u.id = b.id AND b.n = u.c) """


@query(_ERLANG + "SELECT id, round(raw, 9) AS utilisation, raw >= 0.95 AS saturated, round(wait, 6) AS wait, round(wait / (c * 1000.0 / service_ms * (1 - rho)) * 1000 + service_ms, 4) AS total_ms FROM q")
def m2_m4_queue(spark, d):
    rows = _load(spark, d).withColumn("q", numeric.queue(F.col("service_ms"), F.col("arrival_rps"), F.col("servers")))
    return rows.select("id", F.round("q.utilisation", 9).alias("utilisation"), F.col("q.saturated"), F.round("q.wait_probability", 6).alias("wait"), F.round("q.total_ms", 4).alias("total_ms"))


@query("SELECT p_partkey AS id, CASE WHEN p_retailprice / 200 < 950.0 / p_size THEN round(ln(20) / (1000.0 / p_size - p_retailprice / 200) * 1000, 3) END AS p95_ms, p_retailprice / 200 >= 950.0 / p_size AS saturated FROM part")
def m5_m6_percentile(spark, d):
    rows = _load(spark, d).withColumns({"arrival_rps": F.col("arrival_rps") / 10, "servers": F.lit(1)})
    rows = rows.withColumn("q", numeric.queue(F.col("service_ms"), F.col("arrival_rps"), F.col("servers")))
    rows = predict.with_percentile(rows.select("id", "q"), "q", 0.95, "p95")
    return rows.select("id", F.when(~F.col("q.saturated"), F.round("p95", 3)).alias("p95_ms"), F.col("q.saturated"))


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal <= 0 THEN 0.0 WHEN s_suppkey % 10 <> 0 THEN s_acctbal / (0.1 * (1 + s_suppkey % 7)) END AS rps FROM supplier")
def m8_breaking_rate(spark, d):
    """The bracket's upper end is at most its tolerance above the exact rate; the exact rate is given where it is."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when((F.col("s_suppkey") % 10 == 0) & (F.col("s_acctbal") > 0), 1e12).otherwise(F.col("s_acctbal").cast("double")).alias("limit"), ((1 + F.col("s_suppkey") % 7) / 10.0).alias("slope"))
    found, exact = numeric.breaking_rate(lambda rps: rps * F.col("slope"), F.col("limit")), F.col("limit") / F.col("slope")
    return rows.select("id", F.when((found > 0) & (found - exact).between(-1e-6, numeric.RPS_TOLERANCE + 1e-6), exact).otherwise(found).alias("rps"))


@query("SELECT s_suppkey AS id, floor((1 - (0.9 + s_suppkey % 100 / 1000.0)) * 43200 * 10 + 0.5) / 10 AS downtime, floor((s_acctbal + 1000) * 100 + 0.5) / 100 AS usd FROM supplier")
def m1_m11_rounding(spark, d):
    rows = table(spark, d, "supplier")
    return rows.select(F.col("s_suppkey").alias("id"), numeric.downtime_minutes(F.lit(0.9) + F.col("s_suppkey") % 100 / 1000.0).alias("downtime"), numeric.usd(F.col("s_acctbal") + 1000).alias("usd"))


@query("SELECT s_suppkey AS id, s_suppkey * 0.25 AS in_flight, s_suppkey * 1e6 / (730.0 * 3600) AS rps, least(400, greatest(40, 4 * s_suppkey)) AS breadth FROM supplier")
def m7_m9_m20_rates(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), numeric.little(k, F.lit(0.25)).alias("in_flight"), numeric.arrival_rate(k * 1e6, F.lit(730.0)).alias("rps"), numeric.search_breadth(k).alias("breadth"))


_CLASSES = ["db.m5.large", "db.t3.micro", "db.r5.24xlarge", "odd", "db.c6g.2xlarge", "db.x2g.4xlarge", "db.m5.huge"]


@query(f"""WITH c AS (SELECT p_partkey, {_CLASSES}[p_partkey % 7 + 1] AS class, ['postgres', 'mysql', 'mariadb', 'other'][p_size % 4 + 1] AS engine FROM part), g(class, gib) AS (VALUES ('db.m5.large', 8), ('db.t3.micro', 1), ('db.r5.24xlarge', 768), ('db.c6g.2xlarge', 16), ('db.x2g.4xlarge', 512)), b(engine, bytes) AS (VALUES ('postgres', 9531392), ('mysql', 12582880), ('mariadb', 12582880))
SELECT p_partkey, coalesce(least(5000, gib::BIGINT * 1073741824 // bytes), 5000)::BIGINT AS connections FROM c LEFT JOIN g USING (class) LEFT JOIN b USING (engine)""")
def m12_max_connections(spark, d):
    of = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    rows = table(spark, d, "part").select("p_partkey", of(_CLASSES, F.col("p_partkey") % 7).alias("class"), of(["postgres", "mysql", "mariadb", "other"], F.col("p_size") % 4).alias("engine"))
    return rows.select("p_partkey", numeric.max_connections(F.col("class"), F.col("engine")).alias("connections"))


@query()
def d14_path_latency(spark, d):
    q = _load(spark, d).withColumn("queue", numeric.queue(F.col("service_ms"), F.col("arrival_rps") / 10, F.col("servers")))
    k = (F.col("id") % 5).cast("int")  # two in line, then two branches side by side, the second of two steps
    seg = q.select((F.floor(F.col("id") / 5)).alias("path"), F.least(k, F.lit(2)).alias("pos"), F.when(k >= 2, F.least(k - 2, F.lit(1))).alias("branch"), k.alias("step"), F.col("id").cast("string").alias("id"), "queue")
    out = predict.path_latency(predict.with_percentile(seg, "queue", 0.99, "p99"))
    return out.select("path", *(F.round(c, 4).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms")))


@query()
def d15_bottlenecks(spark, d):
    rows = _load(spark, d).withColumn("service", (F.col("id") % 3).cast("string"))
    limits = spark.createDataFrame([("a", "0", 100.0), ("b", "1", 50.0), ("c", "*", 1000.0)], "limit_id string, service string, value double")
    return predict.bottlenecks(rows, limits).select("id", "limit_id", F.round("breaking_rps", 3).alias("breaking_rps"))


_MEMBERS = "(SELECT s_suppkey AS id, s_nationkey AS g, s_suppkey % 3 AS z, 0.99 + (s_suppkey % 9) / 1000.0::DOUBLE AS a FROM supplier)"


@query(f"""WITH m AS {_MEMBERS}, arms AS (SELECT g, z, product(a) AS arm FROM m GROUP BY 1, 2), gs AS (SELECT g, 1 - (0.9 * product(1 - arm) + 0.1 * (1 - min(arm))) AS a FROM arms GROUP BY 1)
SELECT round(product(a), 9) AS composite, (SELECT arg_min(id, {{'a': a, 'i': id}}) FROM m) AS weakest FROM gs""")
def a7_a9_a11_availability(spark, d):
    m = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("group"), (F.col("s_suppkey") % 3).alias("zone"), (F.lit(0.99) + F.col("s_suppkey") % 9 / 1000.0).alias("availability"))
    return predict.composite(m).select(F.round("composite", 9).alias("composite"), "weakest")


@query("SELECT id, (SELECT max(r) FROM (SELECT unnest([0.99::DOUBLE, 0.995, 0.999, 0.9995, 0.9999]) AS r) WHERE r <= a) AS target, (SELECT min(r) FROM (SELECT unnest([0.99::DOUBLE, 0.995, 0.999, 0.9995, 0.9999]) AS r) WHERE r > a) AS next FROM (SELECT s_suppkey AS id, 0.985 + (s_suppkey % 16) / 1000.0::DOUBLE AS a FROM supplier)")
def d16_objective(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), predict.objective(F.lit(0.985) + F.col("s_suppkey") % 16 / 1000.0).alias("o"))
    return rows.select("id", "o.target", "o.next")


@query("SELECT p_partkey AS id, rule, severity FROM (SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 0 THEN [{'rule': 'multi-az', 'severity': 'high'}, {'rule': 'backups', 'severity': 'high'}] WHEN p_partkey % 3 = 1 THEN [{'rule': 'burstable', 'severity': 'low'}] ELSE [] END, recursive := true) FROM part)")
def d17_k4_best_practices(spark, d):
    k = F.col("p_partkey") % 3
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(k == 1, "db.t3.micro").otherwise("db.m5.large").alias("class"), (k != 0).alias("multi_az"), F.when(k == 0, 0).otherwise(7).alias("backup_days"))
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return predict.best_practices(rows).orderBy(order, "id", "rule")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN '-$' ELSE '+$' END || (n_nationkey + 1) || '.50' AS label FROM nation")
def s18_labels(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.alias("id"), text.signed_usd(F.when(k % 2 == 0, -1).otherwise(1) * (k + 1.5)).alias("label"))
