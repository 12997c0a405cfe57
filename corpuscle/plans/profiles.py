"""Profile queries: manifests, signatures, components, citations, patches."""

import json

from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators import patches, profile
from corpuscle.plans.base import query, table

_SIGNATURES = [("npm", "steel", "ui", "frontend"), ("pypi", "tin", "web", "http-server"), ("go", "acme.org/brass", "web", "http-server"), ("go", "acme.org", "org", None), ("cargo", "copper", "queue", "kafka")]


def _manifests(spark, d):
    """A manifest a part: the words of its type are its dependencies, in the form of one of five ecosystems; some are broken."""
    k, words = F.col("p_partkey"), F.split(F.lower("p_type"), " ")
    lines = lambda sep, put: F.array_join(F.transform(words, put), sep)
    lit = F.lit
    npm = F.concat(lit('{"private": true, "name": "n'), k.cast("string"), lit('", "dependencies": {'), lines(", ", lambda w: F.concat(lit('"'), w, lit('": "1"'))), lit("}}"))
    pip = F.concat(lines("\n", lambda w: F.concat(w, lit("==1.0 # it"))), lit("\n-r more.txt\nhttps://x/y.whl\n"))
    gomod = F.concat(lit("module acme/"), k.cast("string"), lit("\nrequire (\n"), lines("\n", lambda w: F.concat(lit("  acme.org/"), w, lit("/v2 v1"))), lit("\n)\n"))
    cargo = F.concat(lit("[workspace]\n[dependencies]\n"), lines("\n", lambda w: F.concat(w, lit(' = "1"'))))
    content = F.when(k % 5 == 0, npm).when(k % 5 == 1, pip).when(k % 5 == 2, gomod).when(k % 5 == 3, cargo).otherwise(lit("{"))
    name = F.get(F.array(*map(lit, ["package.json", "requirements.txt", "go.mod", "Cargo.toml", "package.json"])), (k % 5).cast("int"))
    return profile.manifests(table(spark, d, "part").select(F.concat(lit("p"), k.cast("string"), lit("/"), name).alias("path"), content.alias("content")))


_MANIFESTS = """m AS (SELECT p_partkey AS k, 'p' || p_partkey || '/' || ['package.json', 'requirements.txt', 'go.mod', 'Cargo.toml', 'package.json'][p_partkey % 5 + 1] AS path, ['npm', 'pypi', 'go', 'cargo', NULL][p_partkey % 5 + 1] AS ecosystem,
  CASE WHEN p_partkey % 5 = 4 THEN [] ELSE list_transform(string_split(lower(p_type), ' '), lambda w: CASE WHEN p_partkey % 5 = 2 THEN 'acme.org/' || w || '/v2' ELSE w END) END AS deps FROM part)"""


@query(f"WITH {_MANIFESTS} SELECT path, ecosystem, CASE k % 5 WHEN 0 THEN 'n' || k WHEN 2 THEN 'acme/' || k END AS name, k % 5 = 3 AS library_hint, array_to_string(list_sort(deps), ',') AS deps, CASE WHEN k % 5 = 4 THEN 'JSONDecodeError' END AS error FROM m")
def d6_manifests(spark, d):
    return _manifests(spark, d).select("path", "ecosystem", "name", "library_hint", F.array_join(F.array_sort("dependencies"), ",").alias("deps"), "error")


@query(f"""WITH {_MANIFESTS} SELECT DISTINCT ecosystem, dep AS name, CASE WHEN ecosystem = 'npm' AND dep = 'steel' THEN 'frontend' WHEN ecosystem = 'pypi' AND dep = 'tin' OR dep = 'acme.org/brass/v2' THEN 'http-server' WHEN ecosystem = 'cargo' AND dep = 'copper' THEN 'kafka' END AS capability FROM (SELECT ecosystem, unnest(deps) AS dep FROM m)""")
def d7_signatures(spark, d):
    deps = _manifests(spark, d).select("ecosystem", F.explode("dependencies").alias("name")).distinct()
    return profile.signatures(deps, spark.createDataFrame(_SIGNATURES, "ecosystem string, name string, category string, capability string")).select("ecosystem", "name", "capability")


_PLACES = ["svc/tests", "svc/fixtures", "svc/POC", "specs", "a/Storybook/b", "libs", "apps", "svc/load-tests", "_templates", "services"]


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 10 IN (0, 3, 7) THEN 'test' WHEN p_partkey % 10 IN (1, 2, 4, 8) THEN 'example' WHEN p_size % 2 = 0 THEN 'api' WHEN p_partkey % 3 = 0 THEN 'worker' WHEN p_partkey % 10 = 5 THEN 'library' ELSE 'unknown' END AS kind FROM part)
SELECT p_partkey, kind, kind IN ('api', 'worker') AND p_partkey % 3 = 0 AS deployable FROM c""")
def d8_components(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.get(F.array(*map(F.lit, _PLACES)), (k % 10).cast("int")), F.lit("/c"), k.cast("string"))
    caps = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("http-server"))).otherwise(F.array(F.lit("postgres")))
    docker = F.when(k % 3 == 0, 1).otherwise(0)
    kind = profile.component_kind(path, caps, docker, F.lit(False), F.lit(False), F.lit(True))
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), profile.deployable(kind, docker > 0).alias("deployable"))


@query("SELECT event_id, least(value / 100, 0.9) AS confidence FROM events WHERE value / 100 >= 0.5")
def f14_confidence(spark, d):
    return profile.confident(table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("confidence")), "confidence")


_CITED = """SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'span_missing' WHEN doc_id % 5 = 1 THEN 'span_changed' WHEN doc_id % 5 = 2 OR trim(regexp_replace(lower(string_split_regex(text, '\r\n|\n|\r')[1]), '\\s+', ' ', 'g')) = '' THEN 'supported' ELSE 'unsupported' END AS verdict FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"""


def _citations(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    k, first = F.col("doc_id") % 5, F.element_at(F.split("text", "\r\n|\n|\r"), 1)
    claim = F.when((k == 2) | (F.trim(F.regexp_replace(first, r"\s+", " ")) == ""), first).otherwise("no such words anywhere zq")
    path = F.col("doc_id").cast("string")
    cites = docs.select(F.col("doc_id").alias("id"), claim.alias("claim"), F.when(k == 0, "none").otherwise(path).alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.when(k == 1, "old").otherwise(F.sha2("text", 256)).alias("sha256"))
    files = docs.select(path.alias("path"), F.sha2("text", 256).alias("file_sha"))
    return cites, files, docs.select(path.alias("path"), F.lit(1).alias("c_start"), F.col("text").alias("content"))


@query(_CITED)
def d18_verify(spark, d):
    return profile.verify(*_citations(spark, d))


@query(f"SELECT count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'unsupported') AS unsupported, count(*) FILTER (verdict = 'span_missing') AS span_missing, count(*) FILTER (verdict = 'span_changed') AS span_changed, round(count(*) FILTER (verdict = 'supported') / count(*), 9) AS literal_share FROM ({_CITED})")
def a17_verdict_counts(spark, d):
    out = profile.verdict_counts(profile.verify(*_citations(spark, d)))
    return out.withColumn("literal_share", F.round("literal_share", 9))


@query("""SELECT c_custkey AS doc, CASE c_custkey % 3 WHEN 1 THEN 'edge e' || c_nationkey || ' refers to a' END AS problem, (CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 0 ELSE 1 END)::INT AS undone FROM customer""")
def d3_d4_patches(spark, d):
    """Of three customers one sets a parameter, unties and removes a node, one tries to remove a node that an edge holds, one sets a parameter."""
    rows, k = table(spark, d, "customer"), F.col("c_custkey")
    edge = F.concat(F.lit("e"), F.col("c_nationkey").cast("string"))
    base = F.concat(F.lit('{"nodes": [{"id": "a", "kind": "vpc", "parent": null}, {"id": "b", "kind": "rds", "parent": "a"}], "edges": [{"id": "'), edge, F.lit('", "source": "a", "target": "b"}]}'))
    put = F.concat(F.lit('{"op": "set_param", "nodeId": "b", "param": "size", "value": '), k.cast("string"), F.lit("}"))
    untie = F.concat(F.lit('{"op": "remove_edge", "edgeId": "'), edge, F.lit('"}'))
    gone = lambda n: F.lit(json.dumps({"op": "remove_node", "nodeId": n}))
    ops = F.when(k % 3 == 0, F.array(put, untie, gone("b"))).when(k % 3 == 1, F.array(gone("a"))).otherwise(F.array(put))
    steps = rows.select(k.alias("doc"), F.posexplode(ops).alias("pos", "op"))
    return patches.apply_patches(rows.select(k.alias("doc"), base.alias("document")), steps).select("doc", "problem", F.size("inverse").alias("undone"))


@query("""WITH n AS (SELECT p_partkey, p_brand, string_split_regex(p_type, '[^A-Za-z]+') AS w FROM part), c AS (SELECT p_partkey, p_brand, list_transform(list_filter(w, lambda x: x <> ''), lambda x: upper(left(x, 1)) || lower(substr(x, 2))) AS w FROM n)
SELECT p_partkey, regexp_replace(lower(p_brand), '[_.]', '-', 'g') AS pypi, array_to_string(list_sort(list_distinct(list_append(list_transform(w, lambda x: lower(x)), lower(array_to_string(w, ''))))), ' ') AS terms FROM c""")
def s9_s17_names(spark, d):
    camel = F.regexp_replace(F.initcap(F.regexp_replace("p_type", "[^A-Za-z]+", " ")), " ", "")
    return table(spark, d, "part").select("p_partkey", text.pypi_name(F.col("p_brand")).alias("pypi"), F.array_join(text.expanded_terms(camel), " ").alias("terms"))
