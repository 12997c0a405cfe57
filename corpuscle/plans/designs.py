"""Architecture queries: repositories of eight parts each."""

from pyspark.sql import functions as F

from corpuscle.operators import architecture, canvas
from corpuscle.plans.base import query, table

CAPS = ["postgres", "mysql", "redis", "mongodb", "vector-search", "background-jobs", "object-storage", "llm-api", "kafka", "email", "http-server", "graphql", "frontend", "gpu-inference", "cassandra", "streaming"]
KINDS = ["api", "frontend", "worker", "ml-service", "unknown", "library"]
#: What can be drawn; neither a stream nor a store of wide columns.
CATALOG = [(s, {"tier": "default"}) for s in sorted({s for _, s, *_ in architecture.STORES + architecture.EXTERNALS} - {"kinesis", "keyspaces"} | {"rds", "ecs", "ec2", "s3", "cloudfront", "alb", "sagemaker-endpoint"})]


def _profiles(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    caps, kinds = (F.array(*map(F.lit, names)) for names in (CAPS, KINDS))
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_name", F.concat(F.lit("r"), F.floor(k / 8)).alias("repo"), (k % 8).cast("int").alias("pos"))
    path = F.concat(F.lit("apps/"), "pos")
    own = F.array_distinct(F.array(F.get(caps, (size % 16).cast("int")), F.get(caps, (k * 3 % 16).cast("int"))))
    named = lambda n: F.concat(F.lit("s"), ((F.col("pos") + n) % 8).cast("string"))
    components = part.select(
        "repo", "pos", path.alias("path"), F.col("p_name").alias("name"), F.get(kinds, ((k * 7 + size) % 6).cast("int")).alias("kind"), (k % 5 != 0).alias("deployable"), own.alias("capabilities"),
        F.when(size % 2 == 0, F.array(F.concat(path, F.lit("/Dockerfile")))).alias("dockerfiles"), F.array(F.concat(path, F.lit("/a.json"))).alias("manifests"), F.when(k % 3 == 0, named(0)).alias("compose_service"),
        F.when(size % 3 == 0, F.array(F.lit(80), F.lit(443))).when(size % 3 == 1, F.array(size.cast("int"))).alias("ports"),
        F.transform(own, lambda c: F.struct(F.concat(F.lit("lib-"), c).alias("name"), c.alias("capability"), F.concat(path, F.lit("/a.json")).alias("source"))).alias("dependencies"),
    )
    compose = part.where("p_partkey % 3 <> 2").select("repo", "pos", named(0).alias("name"), F.lit("compose.yml").alias("file"), F.when(k % 3 == 1, F.get(caps, (size % 9).cast("int"))).alias("capability"), F.array(size.cast("int")).alias("ports"), F.array(named(1), named(3)).alias("depends_on"))
    repos = part.select("repo", F.concat(F.lit("Shop "), "repo").alias("repo_name")).distinct()
    return architecture.synthesise(repos, components, compose, spark.createDataFrame(CATALOG, "service string, defaults map<string,string>"))


_CAPS = "[" + ", ".join(f"'{c}'" for c in CAPS) + "]"
_RULES = ", ".join(f"('{c}', '{s}', '{n}', 'medium', 'data')" for c, s, n, _ in architecture.STORES) + ", " + ", ".join(f"('{c}', '{s}', '{n}', '{sure}', 'outside')" for c, s, n, _, sure in architecture.EXTERNALS)
_BASE = f"""WITH p AS (SELECT *, 'r' || (p_partkey // 8) AS repo, p_partkey % 8 AS pos FROM part),
c AS (SELECT repo, pos, p_name AS name, {KINDS}[(p_partkey * 7 + p_size) % 6 + 1] AS kind, p_partkey % 5 <> 0 AS deployed, list_distinct([{_CAPS}[p_size % 16 + 1], {_CAPS}[p_partkey * 3 % 16 + 1]]) AS caps, p_size % 2 = 0 OR p_partkey % 3 = 0 AS packaged, p_size % 2 = 0 AS image,
  CASE WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 3 = 1 THEN 1 ELSE 0 END AS n_ports FROM p),
s AS (SELECT repo, pos, 's' || pos AS name, CASE WHEN p_partkey % 3 = 1 THEN {_CAPS}[p_size % 9 + 1] END AS cap FROM p WHERE p_partkey % 3 <> 2),
live AS (SELECT DISTINCT repo FROM c WHERE deployed), dep AS (SELECT repo, pos, kind, deployed, unnest(caps) AS cap FROM c),
fact AS (SELECT repo, cap, count(*) FILTER (of = 'need') AS needing, count(*) FILTER (of = 'run') AS runs, count(*) FILTER (of <> 'need') > 0 AS has FROM (SELECT repo, cap, 'dep' AS of FROM dep UNION ALL SELECT repo, cap, 'need' FROM dep WHERE deployed UNION ALL SELECT repo, cap, 'run' FROM s WHERE cap IS NOT NULL) JOIN live USING (repo) GROUP BY ALL),
rule(cap, service, node_id, sure, grp) AS (VALUES {_RULES}),
run AS (SELECT *, kind = 'ml-service' AND NOT (list_contains(caps, 'http-server') OR list_contains(caps, 'graphql')) AS model FROM c WHERE deployed AND kind <> 'frontend'),
framed AS (SELECT repo, bool_or(packaged) AS boxed FROM run WHERE NOT model GROUP BY 1),
base AS (SELECT repo, pos, cap, 'database-s' || pos AS node_id, 'high' AS confidence FROM s JOIN live USING (repo) WHERE cap IN ('postgres', 'mysql') UNION ALL
  SELECT repo, 0, max(cap), 'database-primary', 'medium' FROM fact WHERE has AND cap IN ('postgres', 'mysql') AND repo NOT IN (SELECT repo FROM s WHERE cap IN ('postgres', 'mysql')) GROUP BY repo),
stand AS (SELECT repo, cap, service, node_id, CASE WHEN grp = 'data' AND runs > 0 THEN 'high' ELSE sure END AS confidence, grp FROM fact JOIN rule USING (cap) WHERE cap NOT IN ('background-jobs', 'secrets') AND CASE WHEN grp = 'data' THEN needing + runs > 0 ELSE has END
  UNION ALL SELECT repo, 'secrets', 'secrets-manager', 'secrets-llm', 'high', 'outside' FROM fact WHERE cap = 'llm-api' AND has
  UNION ALL SELECT repo, 'background-jobs', 'sqs', 'queue-primary', 'high', 'outside' FROM (SELECT repo FROM fact WHERE cap = 'background-jobs' AND has UNION SELECT repo FROM run WHERE kind = 'worker')),
kept AS (SELECT * FROM stand WHERE service NOT IN ('kinesis', 'keyspaces'))
"""


@query(f"""{_BASE} SELECT repo, CASE WHEN model THEN 'inference-' ELSE 'compute-' END || 'apps-' || pos AS node_id, CASE WHEN model THEN 'sagemaker-endpoint' WHEN packaged THEN 'ecs' ELSE 'ec2' END AS service, CASE WHEN model THEN NULL WHEN packaged THEN 'compute-cluster' ELSE 'network-private' END AS parent_id, CASE WHEN packaged AND NOT model THEN 'high' ELSE 'medium' END AS confidence, (1 + image::INT)::INT AS n_evidence FROM run
UNION ALL SELECT repo, 'frontend-' || x[1] || '-apps-' || pos, x[2], NULL, 'high', (1 + image::INT)::INT FROM (SELECT *, unnest([['bucket', 's3'], ['cdn', 'cloudfront']]) AS x FROM c WHERE deployed AND kind = 'frontend')
UNION ALL SELECT repo, x[1], x[2], nullif(x[3], ''), 'high', 0 FROM (SELECT *, unnest([['network-vpc', 'vpc-environment', ''], ['network-public', 'public-subnet', 'network-vpc'], ['network-private', 'private-subnet', 'network-vpc'], ['ingress-alb', 'alb', 'network-public'], ['compute-cluster', 'ecs-cluster', 'network-private']]) AS x FROM framed) WHERE boxed OR x[1] <> 'compute-cluster'
UNION ALL SELECT b.repo, node_id, 'rds', 'network-private', confidence, CASE WHEN confidence = 'high' THEN 1 ELSE (SELECT count(*) FROM dep WHERE dep.repo = b.repo AND dep.cap = b.cap AND deployed) END::INT FROM base b JOIN framed USING (repo)
UNION ALL SELECT k.repo, node_id, service, CASE WHEN grp = 'data' THEN 'network-private' END, confidence, CASE WHEN grp = 'data' AND confidence = 'high' THEN 1 ELSE (SELECT count(DISTINCT pos) FROM dep WHERE dep.repo = k.repo AND deployed AND (dep.cap = CASE k.cap WHEN 'secrets' THEN 'llm-api' ELSE k.cap END OR k.cap = 'background-jobs' AND dep.kind = 'worker')) END::INT FROM kept k LEFT JOIN framed USING (repo) WHERE grp = 'outside' OR framed.repo IS NOT NULL""")
def d9_nodes(spark, d):
    return _profiles(spark, d).nodes.select("repo", "node_id", "service", "parent_id", "confidence", F.size("evidence").alias("n_evidence"))


@query(f"""{_BASE}, alias AS (SELECT repo, name, max_by(node_id, [a, b]) AS node_id FROM (SELECT repo, 's' || pos AS name, CASE WHEN model THEN 'inference-apps-' ELSE 'compute-apps-' END || pos AS node_id, -1 AS a, pos AS b FROM run JOIN p USING (repo, pos) WHERE p_partkey % 3 = 0
  UNION ALL SELECT repo, 's' || pos, node_id, 0, pos FROM base WHERE confidence = 'high' UNION ALL SELECT k.repo, s.name, node_id, 1, s.pos FROM kept k JOIN s USING (repo, cap) WHERE cap <> 'background-jobs') GROUP BY ALL),
asked AS (SELECT s.repo, s.name, a.node_id AS source, unnest(['s' || (s.pos + 1) % 8, 's' || (s.pos + 3) % 8]) AS dep FROM s JOIN alias a USING (repo, name)),
declared AS (SELECT DISTINCT asked.repo, asked.name, source, b.node_id AS target FROM asked JOIN alias b ON b.repo = asked.repo AND b.name = dep WHERE b.node_id <> source),
shared AS (SELECT repo, cap, node_id FROM base UNION ALL SELECT repo, cap, node_id FROM kept),
node AS (SELECT repo, pos, caps, kind, CASE WHEN model THEN 'inference-apps-' ELSE 'compute-apps-' END || pos AS source, CASE WHEN p_partkey % 3 = 0 THEN 's' || pos END AS svc, list_contains(caps, 'http-server') OR list_contains(caps, 'graphql') AS serves FROM run JOIN p USING (repo, pos)),
e AS (SELECT repo, source, target, 'depends_on' AS label, 'declared' AS origin, 0 AS r, '' AS o FROM declared
  UNION ALL SELECT repo, 'frontend-bucket-apps-' || pos, 'frontend-cdn-apps-' || pos, 'origin', 'inferred', 1, '' FROM c WHERE deployed AND kind = 'frontend'
  UNION ALL SELECT repo, 'frontend-cdn-apps-' || pos, 'ingress-alb', 'API requests', 'inferred', 1, '' FROM c JOIN framed USING (repo) WHERE deployed AND kind = 'frontend'
  UNION ALL SELECT repo, 'ingress-alb', source, 'HTTP', 'inferred', 1, '' FROM node JOIN framed USING (repo) WHERE serves AND kind <> 'worker'
  UNION ALL SELECT n.repo, n.source, x.node_id, x.cap, 'inferred', 2, x.cap FROM node n JOIN shared x ON x.repo = n.repo AND list_contains(n.caps, x.cap) WHERE NOT (EXISTS (FROM declared d WHERE d.repo = n.repo AND d.name = n.svc) AND EXISTS (FROM alias a JOIN s USING (repo, name) WHERE a.repo = n.repo AND a.node_id = x.node_id) AND NOT EXISTS (FROM declared d WHERE d.repo = n.repo AND d.name = n.svc AND d.target = x.node_id))
  UNION ALL SELECT n.repo, n.source, 'queue-primary', 'consumes', 'inferred', 3, '' FROM node n WHERE kind = 'worker')
SELECT repo, source, target, min_by(label, r) AS label, min_by(origin, r) AS origin FROM e GROUP BY ALL""")
def d9_edges(spark, d):
    return _profiles(spark, d).edges


@query(f"""{_BASE}, al AS (SELECT repo, 's' || pos AS name FROM run JOIN p USING (repo, pos) WHERE p_partkey % 3 = 0 UNION SELECT repo, 's' || pos FROM base WHERE confidence = 'high' UNION SELECT k.repo, s.name FROM kept k JOIN s USING (repo, cap) WHERE cap <> 'background-jobs')
SELECT repo, 'no service' AS kind, cap AS subject, service AS detail FROM stand WHERE service IN ('kinesis', 'keyspaces') UNION SELECT repo, 'nothing deployable', '', '' FROM p WHERE repo NOT IN (FROM live)
UNION SELECT repo, 'role unknown', name, '' FROM c WHERE deployed AND kind = 'unknown' UNION SELECT repo, 'several ports', name, '80, 443' FROM run WHERE NOT model AND n_ports = 2
UNION SELECT repo, 'dependency not drawn', name, dep FROM (SELECT s.repo, s.name, unnest(['s' || (s.pos + 1) % 8, 's' || (s.pos + 3) % 8]) AS dep FROM s JOIN al USING (repo, name)) WHERE (repo, dep) IN (SELECT (repo, name) FROM s) AND (repo, dep) NOT IN (SELECT (repo, name) FROM al)""")
def d9_gaps(spark, d):
    return _profiles(spark, d).gaps


@query()
def d9_decisions(spark, d):
    return _profiles(spark, d).decisions.select("repo", "node_id", "title", "why", "confidence")


#: Seven orders a document: each stands in the one before, on its own or in none that there is; they are listed from the last.
_LINES = """l AS (SELECT doc_no::VARCHAR AS doc, 'n' || line AS id, line AS n, (9 - line)::INT AS pos, ['vpc', 'subnet', 'ecs_service', 'ecs_cluster', 'rds_instance', 'ecs_service'][part % 6 + 1] AS kind, 'N' || part AS name,
  CASE WHEN supp % 40 = 0 THEN 'nowhere' WHEN line > 1 AND supp % 4 <> 0 THEN 'n' || (line - 1) END AS parent, CASE WHEN part % 5 > 0 THEN amount / 4 - 3 END AS x, price / 8 AS y, CASE WHEN part % 2 = 0 THEN amount END AS width, CASE WHEN part % 7 > 0 THEN amount * 2 END AS height,
  CASE WHEN part % 4 = 0 THEN 'public' END AS tier FROM (SELECT o_orderkey // 7 AS doc_no, o_orderkey % 7 + 1 AS line, o_custkey AS part, o_custkey // 3 AS supp, floor(o_totalprice) % 50 AS amount, o_totalprice AS price FROM orders))"""
_ABOVE = f"""{_LINES}, up AS (SELECT doc, id, n, parent AS top, 1 AS hops FROM l WHERE parent IS NOT NULL UNION ALL SELECT up.doc, up.id, up.n, l.parent, hops + 1 FROM up JOIN l ON l.doc = up.doc AND l.id = up.top WHERE l.parent IS NOT NULL),
cl AS (SELECT DISTINCT up.doc, up.id FROM up JOIN l ON l.doc = up.doc AND l.id = up.top WHERE l.kind = 'ecs_cluster'), bad AS (SELECT DISTINCT doc FROM l WHERE parent IS NOT NULL AND (doc, parent) NOT IN (SELECT (doc, id) FROM l)),
alone AS (SELECT l.* FROM l ANTI JOIN cl USING (doc, id) WHERE kind = 'ecs_service'),
full_ AS (SELECT doc, id || '-cluster' AS id, 'ecs_cluster' AS kind, name || ' cluster' AS name, parent, coalesce(x, 0) AS x, y, 240.0 AS width, 160.0 AS height FROM alone UNION ALL
  SELECT l.doc, l.id, l.kind, l.name, CASE WHEN a.id IS NULL THEN l.parent ELSE l.id || '-cluster' END, CASE WHEN a.id IS NULL THEN coalesce(l.x, 0) ELSE 20 END, CASE WHEN a.id IS NULL THEN l.y ELSE 48 END, l.width, l.height FROM l LEFT JOIN alone a ON a.doc = l.doc AND a.id = l.id)"""


def _lines(spark, d):
    n, part = F.col("line"), F.col("part")
    kinds = F.array(*map(F.lit, ["vpc", "subnet", "ecs_service", "ecs_cluster", "rds_instance", "ecs_service"]))
    of = lambda k: F.concat(F.lit("n"), k.cast("string"))
    key, price, customer = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(F.floor(key / 7).alias("doc_no"), (key % 7 + 1).alias("line"), customer.alias("part"), F.floor(customer / 3).alias("supp"), (F.floor(price) % 50).alias("amount"), price.alias("price"))
    nodes = rows.select(
        F.col("doc_no").cast("string").alias("doc"), of(n).alias("id"), (9 - n).cast("int").alias("pos"), F.get(kinds, (part % 6).cast("int")).alias("kind"), F.concat(F.lit("N"), part.cast("string")).alias("name"),
        F.when(F.col("supp") % 40 == 0, "nowhere").when((n > 1) & (F.col("supp") % 4 != 0), of(n - 1)).alias("parent"), F.when(part % 5 > 0, F.col("amount") / 4 - 3).cast("double").alias("x"), (F.col("price") / 8).cast("double").alias("y"),
        F.when(part % 2 == 0, F.col("amount")).cast("double").alias("width"), F.when(part % 7 > 0, F.col("amount") * 2).cast("double").alias("height"), F.when(part % 4 == 0, "public").alias("tier"), F.lit("{}").alias("params"))
    edges = rows.where("line > 1").select(F.col("doc_no").cast("string").alias("doc"), F.concat(F.lit("e"), n.cast("string")).alias("id"), n.cast("int").alias("pos"), F.lit("calls").alias("kind"), of(n).alias("source"), of(n - 1).alias("target"), F.lit(None).cast("string").alias("label"))
    return nodes, edges


@query(f"WITH RECURSIVE {_ABOVE} SELECT doc, id, (row_number() OVER (PARTITION BY doc ORDER BY id))::INT AS place, kind, name, parent, floor(x + 0.5) AS x, floor(y + 0.5) AS y, width, height FROM full_")
def d5_normalised(spark, d):
    return canvas.normalised(*_lines(spark, d))[0].select("doc", "id", "place", "kind", "name", "parent", "x", "y", "width", "height")


@query(f"""WITH RECURSIVE {_ABOVE}, f AS (SELECT up.doc, up.top AS id, min(l.pos) AS first FROM up JOIN l ON l.doc = up.doc AND l.id = up.id GROUP BY ALL), h AS (SELECT doc, id, max(hops) AS depth FROM up GROUP BY ALL)
SELECT l.doc, l.id, (row_number() OVER (PARTITION BY l.doc ORDER BY least(pos, coalesce(first, pos)), coalesce(depth, 0), pos))::INT AS place, CASE kind WHEN 'vpc' THEN 'vpc-environment' WHEN 'subnet' THEN coalesce(tier, 'private') || '-subnet' WHEN 'ecs_cluster' THEN 'ecs-cluster' ELSE 'service' END AS shape,
CASE kind WHEN 'vpc' THEN 'vpc-environment' WHEN 'subnet' THEN coalesce(tier, 'private') || '-subnet' WHEN 'ecs_cluster' THEN 'ecs-cluster' WHEN 'rds_instance' THEN 'rds' ELSE 'ecs' END AS service, coalesce(x, 0) AS x, CASE WHEN height IS NOT NULL THEN width END AS width
FROM l LEFT JOIN f USING (doc, id) LEFT JOIN h USING (doc, id) WHERE l.doc NOT IN (FROM bad)""")
def d5_canvas(spark, d):
    return canvas.to_canvas(*_lines(spark, d)).nodes.select("doc", "id", "place", "shape", "service", "x", "width")


@query(f"WITH {_LINES} SELECT doc, '/nodes/' || id || '/parent' AS pointer, 'no such node' AS message FROM l WHERE parent IS NOT NULL AND (doc, parent) NOT IN (SELECT (doc, id) FROM l) UNION ALL SELECT doc, '/edges/e' || n || '/target', 'no such node' FROM l WHERE n > 1 AND (doc, 'n' || (n - 1)) NOT IN (SELECT (doc, id) FROM l)")
def d5_problems(spark, d):
    return canvas.to_canvas(*_lines(spark, d)).problems


@query(f"WITH RECURSIVE {_ABOVE} SELECT doc, count(*) AS nodes, count(*) AS alike FROM full_ WHERE doc NOT IN (FROM bad) GROUP BY 1")
def d5_round_trip(spark, d):
    """Of every drawable document, how many nodes its normal form has, and how many of them it still has after a way there and back."""
    nodes, edges = _lines(spark, d)
    drawing = canvas.to_canvas(nodes, edges)
    back = canvas.to_document(drawing.nodes, drawing.edges)
    before, after = (canvas.normalised(*x)[0].drop("width", "height") for x in ((nodes, edges), (back.nodes, back.edges)))
    kept = before.join(drawing.problems.select("doc").distinct(), "doc", "left_anti")
    alike = kept.intersect(after.select(kept.columns)).withColumn("__same", F.lit(1))
    return kept.unionByName(alike, allowMissingColumns=True).groupBy("doc").agg(F.count_if(F.col("__same").isNull()).alias("nodes"), F.count("__same").alias("alike"))
