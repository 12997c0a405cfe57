"""Architecture synthesis against a version that goes through one repository after another."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import architecture as arch

COMPONENTS = "repo string, pos int, path string, name string, kind string, deployable boolean, capabilities array<string>, dockerfiles array<string>, manifests array<string>, compose_service string, ports array<int>, dependencies array<struct<name:string,capability:string,source:string>>"
COMPOSE = "repo string, pos int, name string, file string, capability string, ports array<int>, depends_on array<string>"
CAPS = ["postgres", "mysql", "redis", "mongodb", "vector-search", "background-jobs", "object-storage", "llm-api", "kafka", "email", "http-server", "graphql", "frontend", "gpu-inference", "secrets", "scheduled-jobs"]
SERVICES = sorted({s for _, s, *_ in arch.STORES + arch.EXTERNALS} | {"rds", "ecs", "ec2", "s3", "cloudfront", "alb", "sagemaker-endpoint"})


def trimmed(s):
    return s.strip("-")


def resource(name, suffix):
    return (trimmed(re.sub("[^a-z0-9-]+", "-", name.lower())[:32]) or "app") + "-" + suffix


def slug(path):
    return trimmed(re.sub("[^a-zA-Z0-9]+", "-", path).lower()) or "root"


def brute_one(repo, name, components, compose, catalog):
    """Nodes, edges and gaps of one repository, in the order in which a person would draw them."""
    nodes, edges, gaps, alias, by_cap, data, drawn = {}, {}, set(), {}, {}, [], []
    deployed = [c for c in components if c["deployable"]]
    if not deployed:
        return {}, {}, {("nothing deployable", "", "")}
    caps = lambda c: set(c["capabilities"])
    has = lambda cap: any(d[1] == cap for c in components for d in c["dependencies"]) or any(s["capability"] == cap for s in compose)
    uses = lambda cap: sorted({d[2] for c in deployed for d in c["dependencies"] if d[1] == cap})
    libs = lambda cap: [d[0].lower() for c in deployed for d in c["dependencies"] if d[1] == cap]
    runs_it = lambda cap: [s for s in compose if s["capability"] == cap]
    evidence = lambda c: sorted({*c["manifests"], *c["dockerfiles"]})

    def can(service, cap):
        if service not in catalog and cap:
            gaps.add(("no service", cap, service))
        return service in catalog

    def node(i, service, parent, props, ev, sure, path=None):
        nodes[i, path] = (service, parent, tuple(sorted(({"size": "m"} if service in catalog else {}).items() | {k: str(v) for k, v in props.items() if v is not None}.items())), tuple(ev), sure)

    sites, serving = [], arch.SERVING
    for c in [c for c in deployed if c["kind"] == "frontend"]:
        if all([can("s3", "frontend"), can("cloudfront", "frontend")]):
            s = slug(c["path"])
            node(f"frontend-bucket-{s}", "s3", None, {"bucketName": resource(c["name"], "site"), "staticHosting": "true"}, evidence(c), "high", c["path"])
            node(f"frontend-cdn-{s}", "cloudfront", None, {}, evidence(c), "high", c["path"])
            sites.append(s)
    compute = []
    for c in [c for c in deployed if c["kind"] != "frontend"]:
        packaged = bool(c["dockerfiles"]) or c["compose_service"] is not None
        answers = bool(caps(c) & set(serving))
        if c["kind"] == "ml-service" and not answers and can("sagemaker-endpoint", "ml-inference"):
            compute.append((c, f"inference-{slug(c['path'])}", "sagemaker-endpoint", {"endpointName": resource(c["name"], "endpoint")}, "medium"))
        else:
            if len(c["ports"]) > 1:
                gaps.add(("several ports", c["name"], ", ".join(map(str, c["ports"]))))
            own = next((s["ports"] for s in compose if s["name"] == c["compose_service"]), [])
            port = c["ports"][0] if len(c["ports"]) == 1 else own[0] if len(own) == 1 else None
            service = "ecs" if packaged else "ec2"
            if not can(service, None):
                continue
            compute.append((c, f"compute-{slug(c['path'])}", service, {"serviceName": resource(c["name"], "svc") if packaged else None, "containerPort": port}, "high" if packaged else "medium"))
        if c["compose_service"]:
            alias[c["compose_service"]] = compute[-1][1]
    framed = any(s != "sagemaker-endpoint" for _, _, s, _, _ in compute)
    for c, i, service, props, sure in compute:
        node(i, service, {"ecs": "compute-cluster", "ec2": "network-private"}.get(service), props, evidence(c), sure, c["path"])
    if framed:
        node("network-vpc", "vpc-environment", None, {"name": resource(name, "vpc")}, [], "high")
        node("network-public", "public-subnet", "network-vpc", {}, [], "high")
        node("network-private", "private-subnet", "network-vpc", {}, [], "high")
        if any(s == "ecs" for _, _, s, _, _ in compute):
            node("compute-cluster", "ecs-cluster", "network-private", {"clusterName": resource(name, "cluster")}, [], "high")
        if can("alb", None):
            node("ingress-alb", "alb", "network-public", {}, [], "high")
    declared = runs_it("postgres") + runs_it("mysql")
    if declared:
        for s in declared:
            if can("rds", s["capability"]):
                i = f"database-{slug(s['name'])}"
                data.append((i, "rds", {"engine": s["capability"], "identifier": resource(s["name"], "db")}, [s["file"]], "high"))
                by_cap.setdefault(s["capability"], []).append(i)
                alias[s["name"]] = i
    elif has("postgres") or has("mysql"):
        cap = "postgres" if has("postgres") else "mysql"
        if can("rds", cap):
            data.append(("database-primary", "rds", {"engine": cap, "identifier": resource(name, "db")}, uses(cap), "medium"))
            by_cap[cap] = ["database-primary"]
    for cap, service, i, _ in arch.STORES:
        vectors = libs("vector-search")
        if cap == "vector-search" and vectors and set(vectors) == {"pgvector"} and not runs_it(cap) and by_cap.get("postgres"):
            continue
        if (runs_it(cap) or any(cap in caps(c) for c in deployed)) and can(service, cap):
            data.append((i, service, {}, sorted({s["file"] for s in runs_it(cap)}) if runs_it(cap) else uses(cap), "high" if runs_it(cap) else "medium"))
            by_cap[cap] = [i]
            alias |= {s["name"]: i for s in runs_it(cap)}
    for i, service, props, ev, sure in data if framed else []:
        node(i, service, "network-private", props, ev, sure)
    workers = [c for c in deployed if c["kind"] == "worker"]
    bedrock = any("bedrock" in n for n in libs("llm-api"))
    for cap, service, i, _, sure in arch.EXTERNALS:
        when = {"background-jobs": has(cap) or bool(workers), "secrets": has("llm-api") and not bedrock}.get(cap, has(cap))
        if when and can(service, cap):
            ev = sorted({*uses(cap), *(m for c in workers for m in c["manifests"])}) if cap == "background-jobs" else uses("llm-api" if cap == "secrets" else cap)
            props = {"queue-primary": {"queueName": resource(name, "jobs")}, "storage-objects": {"bucketName": resource(name, "data")}, "secrets-llm": {"secretName": resource(name, "llm") + "/api-key"}}.get(i, {})
            node(i, service, None, props, ev, "high" if cap == "llm-api" and bedrock else sure)
            by_cap[cap] = [i]
            if cap != "background-jobs":
                alias |= {s["name"]: i for s in runs_it(cap)}
    link = lambda s, t, label, origin: edges.setdefault((s, t), (label, origin))
    derived, told = {alias[s["name"]] for s in compose if s["name"] in alias}, {}
    for s in compose:
        if s["name"] in alias:
            for on in s["depends_on"]:
                if on not in alias:
                    if any(o["name"] == on for o in compose):
                        gaps.add(("dependency not drawn", s["name"], on))
                elif alias[on] != alias[s["name"]]:
                    told.setdefault(s["name"], set()).add(alias[on])
                    link(alias[s["name"]], alias[on], "depends_on", "declared")
    for s in sites:
        link(f"frontend-bucket-{s}", f"frontend-cdn-{s}", "origin", "inferred")
        if ("ingress-alb", None) in nodes:
            link(f"frontend-cdn-{s}", "ingress-alb", "API requests", "inferred")
    for c, i, *_ in compute:
        if ("ingress-alb", None) in nodes and c["kind"] != "worker" and caps(c) & set(serving):
            link("ingress-alb", i, "HTTP", "inferred")
        mine = told.get(c["compose_service"])
        for cap, targets in by_cap.items():
            for t in targets if cap in caps(c) else []:
                if t != i and not (mine and t in derived and t not in mine):
                    link(i, t, cap, "inferred")
        if c["kind"] == "worker" and "background-jobs" in by_cap:
            link(i, "queue-primary", "consumes", "inferred")
    if not sites and any(c["kind"] == "frontend" for c in deployed):
        gaps.add(("no host of front ends", "", ""))
    gaps |= {("role unknown", c["name"], "") for c in deployed if c["kind"] == "unknown"}
    return nodes, edges, gaps


def some(seed, n=12):
    r = random.Random(seed)
    repos, components, compose = [], [], []
    for k in range(n):
        repo = f"r{k}"
        repos.append((repo, r.choice(["Shop", "---", "x" * 40, "A_b c"])))
        names = r.sample(["db", "db2", "cache", "web", "jobs", "mail", "ghost"], r.randrange(6))
        for p, name in enumerate(names):
            compose.append((repo, p, name, r.choice(["docker-compose.yml", "dev.yml"]), r.choice([*CAPS[:9], None, None]), r.sample([80, 443], r.randrange(3)), r.choices([*names, "nowhere"], k=r.randrange(4)) if r.random() < 0.8 else None))
        for p in range(r.randrange(7)):
            path = f"apps/{'ABC'[p % 3]}-{p}" if p else "."
            caps = r.sample(CAPS, r.randrange(6))
            deps = [(r.choice([f"lib-{c}", "pgvector", "boto3-Bedrock"]), c, f"{path}/{r.choice('ab')}.json") for c in caps if r.random() < 0.8] + [("left-pad", None, f"{path}/a.json")]
            components.append((repo, p, path, r.choice(["API", "web site", "w" * 36, "_"]), r.choice(["api", "frontend", "worker", "ml-service", "unknown", "library"]), r.random() < 0.8, caps, r.sample([f"{path}/Dockerfile"], r.randrange(2)) or None,
                               [f"{path}/a.json"] * r.randrange(3), r.choice([*names, None]), r.sample([8080, 9090, 3000], r.randrange(3)), deps))
    return repos, components, compose


def brute(repos, components, compose, catalog):
    nodes, edges, gaps = set(), set(), set()
    names = [[c.split(" ")[0] for c in s.split(", ")] for s in (COMPONENTS, COMPOSE)]
    for repo, name in repos:
        mine = [{k: v if v is not None or k == "compose_service" or k == "capability" else [] for k, v in zip(n, row, strict=True)} for n, rows in zip(names, (components, compose), strict=True) for row in rows if row[0] == repo]
        n, e, g = brute_one(repo, name, [m for m in mine if "path" in m], [m for m in mine if "path" not in m], catalog)
        nodes |= {(repo, *k, *v) for k, v in n.items()}
        edges |= {(repo, *k, *v) for k, v in e.items()}
        gaps |= {(repo, *x) for x in g}
    return nodes, edges, gaps


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("lacking", [(), ("redis", "s3", "sagemaker-endpoint", "sqs", "elasticache"), ("alb", "ecs", "rds", "cloudfront", "bedrock")])
def test_against_one_by_one(spark, seed, lacking):
    repos, components, compose = some(seed)
    catalog = [s for s in SERVICES if s not in lacking]
    frames = spark.createDataFrame(repos, "repo string, repo_name string"), spark.createDataFrame(components, COMPONENTS).withColumn("rank", F.lit(1)), spark.createDataFrame(compose, COMPOSE)
    got = arch.synthesise(*frames, spark.createDataFrame([(s, {"size": "m"}) for s in catalog], "service string, defaults map<string,string>"))
    nodes, edges, gaps = brute(repos, components, compose, catalog)
    assert {tuple(r) for r in got.gaps.collect()} == gaps
    assert {(r.repo, r.node_id, r.path, r.service, r.parent_id, tuple(sorted(r.properties.items())), tuple(r.evidence), r.confidence) for r in got.nodes.collect()} == nodes
    assert {(r.repo, r.source, r.target, r.label, r.origin) for r in got.edges.collect()} == edges
    assert {(r.repo, r.node_id) for r in got.decisions.collect()} == {n[:2] for n in nodes}


def test_empty(spark):
    got = arch.synthesise(spark.createDataFrame([], "repo string, repo_name string"), spark.createDataFrame([], COMPONENTS), spark.createDataFrame([], COMPOSE), spark.createDataFrame([], "service string, defaults map<string,string>"))
    assert [f.count() for f in got] == [0, 0, 0, 0]
