"""Architecture of repositories from their profiles: rules as tables, applied by joins. One pass for all repositories."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators.graph import _cut
from corpuscle.operators.profile import SERVING

#: What serves a capability inside the network: capability, service, id of the node, title.
STORES = [
    ("redis", "elasticache", "cache-primary", "Cache"), ("mongodb", "documentdb", "documents-primary", "Documents"), ("elasticsearch", "opensearch", "search-primary", "Search"),
    ("graph-db", "neptune", "graph-primary", "Graph"), ("cassandra", "keyspaces", "wide-column-primary", "Wide columns"), ("dynamodb", "dynamodb", "keyvalue-primary", "Keys and values"),
    ("vector-search", "opensearch-vector", "vectors-primary", "Vectors"), ("clickhouse", "redshift", "analytics-primary", "Analytics"),
]
#: What serves a capability outside of it: capability, service, id of the node, title, confidence.
EXTERNALS = [
    ("background-jobs", "sqs", "queue-primary", "Queue", "high"), ("object-storage", "s3", "storage-objects", "Objects", "high"), ("secrets", "secrets-manager", "secrets-llm", "Key of the model's provider", "high"),
    ("llm-api", "bedrock", "model-bedrock", "Models", "low"), ("document-processing", "textract", "documents-extract", "Text of documents", "low"), ("kafka", "msk", "streaming-kafka", "Log of events", "medium"),
    ("rabbitmq", "amazon-mq", "broker-rabbitmq", "Broker", "medium"), ("streaming", "kinesis", "streaming-kinesis", "Stream", "medium"), ("workflow-orchestration", "step-functions", "workflow-primary", "Workflows", "low"),
    ("scheduled-jobs", "eventbridge", "schedule-primary", "Schedule", "medium"), ("email", "ses", "email-primary", "Mail", "medium"), ("identity", "cognito", "identity-primary", "Users", "low"),
    ("observability", "cloudwatch", "observability-primary", "Metrics", "medium"),
]
#: Nodes that hold others: id, service, parent, title.
FRAMES = [("network-vpc", "vpc-environment", None, "Network"), ("network-public", "public-subnet", "network-vpc", "Public part"), ("network-private", "private-subnet", "network-vpc", "Private part"), ("compute-cluster", "ecs-cluster", "network-private", "Cluster")]

_DRAFT = "repo seq pos node_id service capability properties evidence confidence path title why group".split()
_RULE = "seq int, capability string, service string, node_id string, title string, confidence string, group string"


class Proposal(NamedTuple):
    """nodes: repo, node_id, service, parent_id, properties, evidence, confidence, path. edges: repo, source, target, label, origin.
    decisions: repo, node_id, title, why, evidence, confidence. gaps: repo, kind, subject, detail."""

    nodes: DataFrame
    edges: DataFrame
    decisions: DataFrame
    gaps: DataFrame


def slug(path: Column) -> Column:
    """Lower-case letters and digits of a path, joined by single hyphens; ``root`` if there are none."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(path, "[^a-zA-Z0-9]+", "-")), "^-+|-+$", "")
    return F.when(plain == "", "root").otherwise(plain)


def _paths(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def _props(**values: Column) -> Column:
    """A map of the values that are not null."""
    if not values:
        return F.create_map().cast("map<string,string>")
    full = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))
    return F.map_filter(full, lambda k, v: v.isNotNull())


def _draft(rows: DataFrame, **columns) -> DataFrame:
    """Rows as drafts; what is not named is empty."""
    empty = {"seq": F.lit(0), "pos": F.lit(0), "capability": F.lit(None).cast("string"), "properties": _props(), "evidence": F.array().cast("array<string>"), "path": F.lit(None).cast("string"), "why": F.lit("")}
    c = empty | {k: v if isinstance(v, Column) else F.lit(v) for k, v in columns.items()}
    return rows.select("repo", *(c[k].alias(k) for k in _DRAFT if k != "repo"))


def _facts(components: DataFrame, compose: DataFrame) -> DataFrame:
    """A row for each capability of a repository: how many deployed components need it, what says so, who runs it."""
    needs = components.where("deployable").select("repo", F.explode(F.array_distinct("capabilities")).alias("capability"), F.lit("need").alias("of"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("name"))
    uses = components.select("repo", "deployable", F.explode("dependencies").alias("d")).where("d.capability is not null")
    uses = uses.select("repo", "d.capability", F.when(F.col("deployable"), "use").otherwise("other").alias("of"), "d.source", F.lower("d.name").alias("name"))
    runs = compose.where("capability is not null").select("repo", "capability", F.lit("run").alias("of"), F.col("file").alias("source"), "name")
    of = lambda what, c: F.array_sort(F.collect_set(F.when(F.col("of") == what, F.col(c))))
    return needs.unionByName(uses).unionByName(runs).groupBy("repo", "capability").agg(
        F.count_if(F.col("of") == "need").alias("needing"), of("use", "source").alias("uses"), of("run", "source").alias("files"), of("use", "name").alias("names"), F.max(F.col("of") != "need").alias("has"))


def _compute(deployed: DataFrame, compose: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts of what runs, a row a component, and gaps of ports that are open."""
    ports = compose.groupBy("repo", "name").agg(F.min_by("ports", "pos").alias("__ports"))
    runs = deployed.where("kind <> 'frontend'").join(ports.withColumnRenamed("name", "compose_service"), ["repo", "compose_service"], "left")
    runs = runs.join(catalog.where("service = 'sagemaker-endpoint'").select(F.lit(False).alias("__plain"), F.lit("ml-service").alias("kind")), "kind", "left")
    packaged = (F.size("dockerfiles") > 0) | F.col("compose_service").isNotNull()
    model = (F.col("kind") == "ml-service") & ~F.col("serves")
    endpoint = model & F.col("__plain").isNotNull()
    one = lambda a: F.when(F.size(a) == 1, F.element_at(a, 1))
    port = F.coalesce(one("ports"), one("__ports"))
    service = F.when(endpoint, "sagemaker-endpoint").when(packaged, "ecs").otherwise("ec2")
    named = _props(endpointName=F.when(endpoint, text.resource_name(F.col("name"), F.lit("endpoint"))), serviceName=F.when(~endpoint & packaged, text.resource_name(F.col("name"), F.lit("svc"))), containerPort=F.when(~endpoint, port))
    why = F.when(endpoint, "runs a model and answers no requests").when(packaged, F.concat(F.lit("has an image of its own"), F.when(F.array_contains("capabilities", "gpu-inference"), "; needs a GPU").otherwise(""))).otherwise("serves, without an image")
    drafts = _draft(runs, pos=F.col("pos"), node_id=F.concat(F.when(endpoint, "inference-").otherwise("compute-"), slug(F.col("path"))), service=service, properties=named, evidence=F.col("evidence"), group="compute",
                    confidence=F.when(~endpoint & packaged, "high").otherwise("medium"), path=F.col("path"), title=F.concat(F.when(endpoint, "Model of ").when(F.col("kind") == "worker", "Worker ").otherwise("Service "), "name"), why=why)
    gaps = runs.where(~endpoint & (F.size("ports") > 1)).select("repo", F.lit("several ports").alias("kind"), F.col("name").alias("subject"), F.array_join(F.col("ports").cast("array<string>"), ", ").alias("detail"))
    return drafts, gaps.unionByName(runs.where(model & ~endpoint).select("repo", F.lit("no service").alias("kind"), F.lit("ml-inference").alias("subject"), F.lit("sagemaker-endpoint").alias("detail")))


def _relational(compose: DataFrame, facts: DataFrame, repos: DataFrame) -> DataFrame:
    """A database for each that compose declares, or else one for all that use one; Postgres goes before MySQL."""
    declared = compose.where("capability in ('postgres', 'mysql')")
    each = _draft(declared, seq=F.when(F.col("capability") == "postgres", 0).otherwise(1), pos=F.col("pos"), node_id=F.concat(F.lit("database-"), slug(F.col("name"))), service="rds", capability=F.col("capability"), group="data", confidence="high",
                  properties=_props(engine=F.col("capability"), identifier=text.resource_name(F.col("name"), F.lit("db"))), evidence=F.array("file"), title=F.concat(F.lit("Database "), "name"), why="the compose file declares it")
    used = facts.where("has and capability in ('postgres', 'mysql')").join(declared.select("repo").distinct(), "repo", "left_anti")
    used = used.groupBy("repo").agg(F.max_by("capability", "capability").alias("capability"), F.max_by("uses", "capability").alias("uses")).join(repos, "repo")
    shared = _draft(used, seq=F.when(F.col("capability") == "postgres", 0).otherwise(1), node_id="database-primary", service="rds", capability=F.col("capability"), properties=_props(engine=F.col("capability"), identifier=text.resource_name(F.col("repo_name"), F.lit("db"))),
                    evidence=F.col("uses"), confidence="medium", title="Database", why="clients are declared, but not how many databases", group="data")
    return each.unionByName(shared)


def synthesise(repos: DataFrame, components: DataFrame, compose: DataFrame, catalog: DataFrame) -> Proposal:
    """Nodes, edges, decisions and gaps of every repository.

    repos: repo, repo_name. components: repo, pos, path, name, kind, deployable, capabilities, dockerfiles, manifests,
    compose_service, ports, dependencies (name, capability, source). compose: repo, pos, name, file, capability, ports,
    depends_on. catalog: service and defaults (a map), a row for what can be drawn.

    Every draft names its evidence and how sure it is; one that the catalog lacks becomes a gap. Names that compose gives
    resolve to the last node that stands for them (components, databases, stores, others), and what compose declares goes before
    what capabilities suggest: of edges with the same ends the first one's label stays. Null arrays count as empty,
    rows with a null repo are no one's, repeated components are drafted each. A repository without a deployable component has one
    gap and nothing else; empty tables give empty results. All joins are on the repository and a name, capability or node, and what is
    gathered is the evidence of one capability of one repository.
    """
    arrays = {"capabilities": "array<string>", "dockerfiles": "array<string>", "manifests": "array<string>", "ports": "array<int>", "dependencies": "array<struct<name:string,capability:string,source:string>>"}
    components = components.where("repo is not null").withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in arrays.items()})
    compose = compose.where("repo is not null").withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in (("ports", "array<int>"), ("depends_on", "array<string>"))})
    catalog = catalog.dropDuplicates(["service"])
    serves = F.arrays_overlap("capabilities", F.array(*map(F.lit, SERVING)))
    deployed = components.where("deployable").withColumns({"evidence": _paths(F.col("manifests"), F.col("dockerfiles")), "serves": F.coalesce(serves, F.lit(False))})
    live = repos.where("repo is not null").join(deployed.select("repo").distinct(), "repo")
    facts = _facts(components, compose).join(live, "repo", "left_semi")
    spark = repos.sparkSession
    compute, gaps = _compute(deployed, compose, catalog)
    hosted = deployed.where("kind = 'frontend'")
    hosts = [
        _draft(hosted, pos=F.col("pos"), node_id=F.concat(F.lit(f"frontend-{of}-"), slug(F.col("path"))), service=service, capability="frontend", evidence=F.col("evidence"), confidence="high", path=F.col("path"),
               properties=_props(bucketName=text.resource_name(F.col("name"), F.lit("site")), staticHosting=F.lit("true")) if of == "bucket" else _props(), title=F.concat(F.lit(title), "name"), why="a built front end is files", group="frontend")
        for of, service, title in (("bucket", "s3", "Files of "), ("cdn", "cloudfront", "Delivery of "))
    ]
    relational = _relational(compose.join(live, "repo", "left_semi"), facts, live)
    rules = spark.createDataFrame([(10 + k, c, s, n, t, None, "data") for k, (c, s, n, t) in enumerate(STORES)] + [(30 + k, c, s, n, t, sure, "outside") for k, (c, s, n, t, sure) in enumerate(EXTERNALS)], _RULE)

    # a vector extension of a database is no store of its own
    on_base = facts.where("capability = 'vector-search' and size(names) > 0 and size(files) = 0").where(F.forall("names", lambda n: n == "pgvector"))
    on_base = on_base.join(relational.where("capability = 'postgres'").join(catalog, "service", "left_semi").select("repo").distinct(), "repo", "left_semi").select("repo", "capability")
    stated = F.size("files") > 0
    stores = facts.where((F.col("needing") > 0) | stated).join(on_base, ["repo", "capability"], "left_anti").join(rules.where("group = 'data'"), "capability")
    stores = _draft(stores, seq=F.col("seq"), node_id=F.col("node_id"), service=F.col("service"), capability=F.col("capability"), evidence=F.when(stated, F.col("files")).otherwise(F.col("uses")), group="data",
                    confidence=F.when(stated, "high").otherwise("medium"), title=F.col("title"), why=F.when(stated, "compose runs it").otherwise("a client is declared"))

    workers = deployed.where("kind = 'worker'").groupBy("repo").agg(_paths(F.flatten(F.collect_list("manifests"))).alias("work"))
    direct = F.exists("names", lambda n: n.contains("bedrock"))
    none = F.array().cast("array<string>")
    jobs = facts.where("has and capability = 'background-jobs'").select("repo", "uses").join(workers, "repo", "full")
    jobs = jobs.select("repo", F.lit("background-jobs").alias("capability"), _paths(F.coalesce("uses", none), F.coalesce("work", none)).alias("uses"), F.lit(False).alias("direct"))
    others = facts.where("has and capability not in ('background-jobs', 'secrets')").select("repo", "capability", "uses", ((F.col("capability") == "llm-api") & direct).alias("direct"))
    keys = others.where("capability = 'llm-api' and not direct").withColumn("capability", F.lit("secrets"))
    outside = jobs.unionByName(others).unionByName(keys).join(rules.where("group = 'outside'"), "capability").join(live, "repo")
    name = lambda suffix, more="": F.concat(text.resource_name(F.col("repo_name"), F.lit(suffix)), F.lit(more))
    given = lambda node, value: F.when(F.col("node_id") == node, value)
    outside = _draft(outside, seq=F.col("seq"), node_id=F.col("node_id"), service=F.col("service"), capability=F.col("capability"), evidence=F.col("uses"), confidence=F.when(F.col("direct"), "high").otherwise(F.col("confidence")), title=F.col("title"), group="outside",
                     properties=_props(queueName=given("queue-primary", name("jobs")), bucketName=given("storage-objects", name("data")), secretName=given("secrets-llm", name("llm", "/api-key"))), why=F.when(F.col("direct"), "it is called already").otherwise("a client is declared"))

    wanted = compute
    for more in (*hosts, relational, stores, outside):
        wanted = wanted.unionByName(more)
    known = catalog.select("service", F.coalesce("defaults", _props()).alias("defaults"))
    wanted = _cut(wanted.join(known, "service", "left"))
    gaps = gaps.unionByName(wanted.where("defaults is null and capability is not null").select("repo", F.lit("no service").alias("kind"), F.col("capability").alias("subject"), F.col("service").alias("detail")))
    drawn = wanted.where("defaults is not null").withColumn("properties", F.map_zip_with("defaults", "properties", lambda k, a, b: F.coalesce(b, a))).drop("defaults")
    pairs = drawn.where("group = 'frontend'").groupBy("repo", "path", "pos").agg(F.countDistinct("service").alias("n")).where("n = 2").select("repo", "path", "pos", F.lit("frontend").alias("group"))
    whole = drawn.where("group <> 'frontend'").unionByName(drawn.join(pairs, ["repo", "path", "pos", "group"], "left_semi"))

    # where things stand
    inside = whole.where("group = 'compute'").groupBy("repo").agg(F.count_if(F.col("service") != "sagemaker-endpoint").alias("n"), F.count_if(F.col("service") == "ecs").alias("ecs")).where("n > 0")
    frames = spark.createDataFrame(FRAMES, "node_id string, service string, parent_id string, title string")
    holders = inside.join(live, "repo").crossJoin(F.broadcast(frames)).where("node_id <> 'compute-cluster' or ecs > 0").join(known, "service", "left")
    own = _props(name=given("network-vpc", name("vpc")), clusterName=given("compute-cluster", name("cluster")))
    holders = holders.select("repo", "node_id", "service", "parent_id", F.map_zip_with(F.coalesce("defaults", _props()), own, lambda k, a, b: F.coalesce(b, a)).alias("properties"), F.array().cast("array<string>").alias("evidence"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("path"), "title", F.lit("a frame for what is inside").alias("why"))
    balancer = inside.select("repo", F.lit("alb").alias("service")).join(known, "service")
    balancer = balancer.select("repo", F.lit("ingress-alb").alias("node_id"), "service", F.lit("network-public").alias("parent_id"), F.col("defaults").alias("properties"), F.array().cast("array<string>").alias("evidence"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("path"), F.lit("Load balancer").alias("title"), F.lit("services have no address of their own").alias("why"))
    placed = whole.join(inside.select("repo", F.lit(True).alias("framed")), "repo", "left").where("group <> 'data' or framed")
    parent = F.when(F.col("group") == "data", "network-private").when(F.col("group") == "compute", F.when(F.col("service") == "ecs", "compute-cluster").when(F.col("service") != "sagemaker-endpoint", "network-private"))
    columns = ["repo", "node_id", "service", "parent_id", "properties", "evidence", "confidence", "path", "title", "why"]
    every = placed.withColumn("parent_id", parent).select(columns).unionByName(holders.select(columns)).unionByName(balancer.select(columns))

    # edges that compose declares
    runs = whole.where("group = 'compute'").join(deployed.select("repo", "path", "pos", "kind", "serves", "capabilities", "compose_service"), ["repo", "path", "pos"])
    shared = whole.where("capability is not null and group in ('data', 'outside')")
    replaces = shared.where("service <> 'rds' and node_id <> 'queue-primary'").join(compose.select("repo", "capability", F.col("name"), F.col("pos").alias("at")), ["repo", "capability"])
    bases = shared.where("service = 'rds' and node_id <> 'database-primary'").withColumn("__slug", F.col("node_id")).join(compose.where("capability in ('postgres', 'mysql')").select("repo", "name", "capability", "pos"), ["repo", "capability", "pos"])
    alias = runs.where("compose_service is not null").select("repo", F.col("compose_service").alias("name"), "node_id", F.struct(F.lit(-1).alias("a"), F.col("pos").alias("b")).alias("rank"))
    alias = alias.unionByName(bases.select("repo", "name", "node_id", F.struct(F.col("seq").alias("a"), F.col("pos").alias("b")).alias("rank"))).unionByName(replaces.select("repo", "name", "node_id", F.struct(F.col("seq").alias("a"), F.col("at").alias("b")).alias("rank")))
    alias = _cut(alias.groupBy("repo", "name").agg(F.max_by("node_id", "rank").alias("node_id")))
    asked = compose.select("repo", "name", "file", "pos", F.posexplode("depends_on").alias("k", "on")).join(alias.withColumnRenamed("node_id", "source"), ["repo", "name"])
    asked = asked.join(alias.select("repo", F.col("name").alias("on"), F.col("node_id").alias("target")), ["repo", "on"], "left")
    there = compose.select("repo", F.col("name").alias("on")).distinct()
    lost = asked.where("target is null").join(there, ["repo", "on"], "left_semi").select("repo", F.lit("dependency not drawn").alias("kind"), F.col("name").alias("subject"), F.col("on").alias("detail"))
    declared = asked.where("target is not null and source <> target")
    rank = lambda a, b, c: F.struct(F.lit(a).alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c")).alias("rank")
    edge = lambda rows, s, t, label, origin, r: rows.select("repo", s.alias("source"), t.alias("target"), label.alias("label"), F.lit(origin).alias("origin"), r)
    zero, of = F.lit(0), F.col
    edges = edge(declared, of("source"), of("target"), F.lit("depends_on"), "declared", rank(0, of("pos"), of("k")))

    # edges that follow from what nodes are
    bucket, cdn = (whole.where(f"group = 'frontend' and service = '{s}'").select("repo", "path", "pos", F.col("node_id").alias(s)) for s in ("s3", "cloudfront"))
    sites = bucket.join(cdn, ["repo", "path", "pos"])
    edges = edges.unionByName(edge(sites, of("s3"), of("cloudfront"), F.lit("origin"), "inferred", rank(1, of("pos"), zero)))
    edges = edges.unionByName(edge(sites.join(balancer.select("repo", "node_id"), "repo"), of("cloudfront"), of("node_id"), F.lit("API requests"), "inferred", rank(2, of("pos"), zero)))
    served = runs.where("serves and kind <> 'worker'").join(balancer.select("repo", F.col("node_id").alias("alb")), "repo")
    edges = edges.unionByName(edge(served, of("alb"), of("node_id"), F.lit("HTTP"), "inferred", rank(3, of("pos"), F.lit(-1))))
    told = declared.select("repo", F.col("name").alias("compose_service"), "target").distinct()
    tells = told.select("repo", "compose_service", F.lit(True).alias("tells")).distinct()
    derived = alias.join(there.withColumnRenamed("on", "name"), ["repo", "name"], "left_semi").select("repo", F.col("node_id").alias("target"), F.lit(True).alias("derived")).distinct()
    met = runs.select("repo", F.col("node_id").alias("source"), "compose_service", F.col("pos").alias("at"), F.explode(F.array_distinct("capabilities")).alias("capability")).join(shared.select("repo", "capability", F.col("node_id").alias("target"), F.col("seq"), F.col("pos")), ["repo", "capability"])
    met = met.where("source <> target").join(tells, ["repo", "compose_service"], "left").join(derived, ["repo", "target"], "left").join(told.withColumn("named", F.lit(True)), ["repo", "compose_service", "target"], "left")
    met = met.where(~(F.coalesce("tells", F.lit(False)) & F.coalesce("derived", F.lit(False)) & F.col("named").isNull()))
    edges = edges.unionByName(edge(met, of("source"), of("target"), of("capability"), "inferred", rank(3, of("at"), of("seq"))))
    work = runs.where("kind = 'worker'").join(whole.where("node_id = 'queue-primary'").select("repo", F.col("node_id").alias("queue")), "repo")
    edges = edges.unionByName(edge(work, of("node_id"), of("queue"), F.lit("consumes"), "inferred", rank(3, of("pos"), F.lit(99))))
    edges = edges.groupBy("repo", "source", "target").agg(F.min_by("label", "rank").alias("label"), F.min_by("origin", "rank").alias("origin"))

    bare = repos.where("repo is not null").join(live, "repo", "left_anti").select("repo", F.lit("nothing deployable").alias("kind"), F.lit("").alias("subject"), F.lit("").alias("detail"))
    unhosted = hosted.select("repo").distinct().join(pairs.select("repo").distinct(), "repo", "left_anti").select("repo", F.lit("no host of front ends").alias("kind"), F.lit("").alias("subject"), F.lit("").alias("detail"))
    unclear = deployed.where("kind = 'unknown'").select("repo", F.lit("role unknown").alias("kind"), F.col("name").alias("subject"), F.lit("").alias("detail"))
    gaps = gaps.unionByName(lost).unionByName(bare).unionByName(unhosted).unionByName(unclear).distinct()
    return Proposal(every.drop("title", "why"), edges, every.select("repo", "node_id", "title", "why", "evidence", "confidence"), gaps)
