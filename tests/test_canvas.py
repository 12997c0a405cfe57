"""Documents and drawings against versions that go node by node."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import canvas

NODES = "doc string, id string, pos int, kind string, name string, parent string, x double, y double, width double, height double, tier string, params string"
EDGES = "doc string, id string, pos int, kind string, source string, target string, label string"
KINDS = ["vpc", "subnet", "ecs_cluster", "ecs_service", "ecs_service", "rds_instance"]


def some(seed, docs=30, faults=False):
    r = random.Random(seed)
    nodes, edges = [], []
    for d in range(docs):
        n = r.randrange(1, 9)
        ids = [f"n{r.randrange(100)}_{k}" for k in range(n)]
        up = {i: r.choice([None, *ids[:k]]) for k, i in enumerate(ids)}
        if faults and d % 3 == 0:
            up[ids[0]] = r.choice([*ids, "nowhere"])
        for pos, k in enumerate(r.sample(range(n), n)):
            size = r.choice([(None, None), (10.0, 20.0), (5.0, None)])
            kind = "internet_gateway" if faults and d % 7 == 1 else r.choice(KINDS)
            nodes.append((f"d{d}", ids[k], pos, kind, f"N{k}", up[ids[k]], r.choice([None, 1.5, -2.5, 3.0, 4.49]), r.choice([None, 0.5, 7.0]), *size, r.choice(["public", "private", None]), r.choice(["{}", None])))
        for e in range(r.randrange(4)):
            a, b = r.choices(ids, k=2)
            if a != b or faults:
                edges.append((f"d{d}", f"e{e}" if not faults or r.random() < 0.9 else "e0", e, "calls", a, b if not faults or r.random() < 0.9 else "gone", r.choice([None, "x"])))
    return nodes, edges


def half_up(x):
    return None if x is None else float(int((x + 0.5) // 1))


def clusters(nodes):
    kinds, up, out = {n[1]: n[3] for n in nodes}, {n[1]: n[5] for n in nodes}, []
    for n in nodes:
        at, held = up.get(n[1]), False
        while at is not None:
            held, at = held or kinds.get(at) == "ecs_cluster", up.get(at)
        if n[3] == "ecs_service" and not held:
            out.append((n[0], n[1] + "-cluster", None, "ecs_cluster", n[4] + " cluster", n[5], n[6] or 0.0, n[7] or 0.0, 240.0, 160.0, None, None))
            n = (*n[:5], n[1] + "-cluster", 20.0, 48.0, *n[8:])
        out.append(n)
    return out


def normal(nodes):
    return [(*n[:2], k + 1, *n[3:6], half_up(n[6] or 0.0), half_up(n[7] or 0.0), *n[8:]) for k, n in enumerate(sorted(clusters(nodes), key=lambda n: n[1]))]


def drawn_order(nodes):
    by, out = {n[1]: n for n in nodes}, []

    def visit(n):
        if n[1] not in out:
            if n[5] is not None:
                visit(by[n[5]])
            out.append(n[1])

    for n in nodes:
        visit(n)
    return out


def by_doc(nodes):
    docs = {}
    for n in nodes:
        docs.setdefault(n[0], []).append(n)
    return docs.values()


def same(a, b):
    return {tuple(r) for r in a.select(canvas.NODE).collect()} == {tuple(r) for r in b.select(canvas.NODE).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_each_way_and_normal_form(spark, seed):
    nodes, edges = some(seed)
    n, e = spark.createDataFrame(nodes, NODES).withColumn("place", F.lit(7)), spark.createDataFrame(edges, EDGES)
    once, lines = canvas.normalised(n, e)
    assert sorted(map(tuple, once.select(canvas.NODE).collect())) == sorted(x for doc in by_doc(nodes) for x in normal(doc))
    assert same(canvas.normalised(once, lines)[0], once)
    drawing = canvas.to_canvas(n.drop("place"), e)
    assert drawing.problems.count() == 0 and drawing.edges.count() == len(edges)
    rows = drawing.nodes.collect()
    for doc in by_doc(nodes):
        assert [r.id for r in sorted((r for r in rows if r.doc == doc[0][0]), key=lambda r: r.place)] == drawn_order(doc)
    back = canvas.to_document(drawing.nodes, drawing.edges)
    # a size that is not whole is no size of a drawing
    whole = n.withColumns({c: F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.col(c)) for c in ("width", "height")})
    assert back.problems.count() == 0 and same(canvas.normalised(back.nodes, back.edges)[0], canvas.normalised(whole, e)[0])
    assert {tuple(r)[1:] for r in canvas.normalised(back.nodes, back.edges)[1].collect()} == {tuple(r)[1:] for r in lines.collect()}


def test_problems(spark):
    nodes, edges = some(5, faults=True)
    nodes += [nodes[0], (None, "a", 1, "vpc", "A", *[None] * 7)]
    found = {tuple(r) for r in canvas.to_canvas(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)).problems.collect()}
    want = set()
    for doc in by_doc([n for n in nodes if n[0]]):
        d, ids, up = doc[0][0], [n[1] for n in doc], {n[1]: n[5] for n in doc}
        mine = [e for e in edges if e[0] == d]
        want |= {(d, f"/nodes/{i}", "repeated id") for i in ids if ids.count(i) > 1} | {(d, f"/edges/{e[1]}", "repeated id") for e in mine if sum(x[1] == e[1] for x in mine) > 1}
        want |= {(d, f"/nodes/{n[1]}/parent", "no such node") for n in doc if n[5] is not None and n[5] not in ids}
        want |= {(d, f"/edges/{e[1]}/{end}", "no such node") for e in mine for end, x in (("source", e[4]), ("target", e[5])) if x not in ids}
        want |= {(d, f"/edges/{e[1]}", "from a node to itself") for e in mine if e[4] == e[5]} | {(d, f"/nodes/{n[1]}/kind", "no shape") for n in doc if n[3] == "internet_gateway"}
        for i in ids:
            at, seen = up.get(i), set()
            while at is not None and at not in seen and at != i:
                seen.add(at)
                at = up.get(at)
            want |= {(d, f"/nodes/{i}/parent", "containment cycle")} if at == i else set()
    assert found == want != set()
    drawing = canvas.to_canvas(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    assert {r.doc for r in drawing.nodes.collect()} == {n[0] for n in nodes if n[0]} - {w[0] for w in want}


def test_empty(spark):
    n, e = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    assert [f.count() for f in canvas.to_canvas(n, e)] == [0, 0, 0] and [f.count() for f in canvas.normalised(n, e)] == [0, 0]
