"""Expansion and communities against brute force on small graphs."""

import itertools
import random

import pytest

from corpuscle.operators import communities as C

EDGES = "source string, target string, kind string"
WEIGHTED = "source string, target string, weight double"


def ways(edges, seed, depth):
    """Best product, fewest steps and fewest steps of the best way of every simple way, by walking them all."""
    step = {}
    for a, b, k in edges:
        if a and b and a != b and k in C.REACH:
            for x, y in ((a, b), (b, a)):
                step.setdefault(x, {})[y] = max(step.get(x, {}).get(y, 0), C.REACH[k])
    found, todo = {}, [(seed, 0, 1.0, (seed,))]
    while todo:
        at, hops, w, seen = todo.pop()
        found.setdefault(at, []).append((-w, hops, seed))
        if hops < depth:
            todo += [(n, hops + 1, w * x, (*seen, n)) for n, x in step.get(at, {}).items() if n not in seen]
    return found


@pytest.mark.parametrize(("most", "depth", "run"), [(200, 2, 0), (5, 2, 1), (3, 2, 2), (4, 1, 3), (9, 0, 4)])
def test_expansion(spark, most, depth, run):
    rng = random.Random(run)
    names = [f"n{i}" for i in range(14)]
    edges = [(rng.choice(names), rng.choice(names), rng.choice([*C.REACH, "unknown", None])) for _ in range(40)] + [(None, "n1", "calls"), ("n1", "n2", "calls"), ("n1", "n2", "calls")]
    seeds = [(q, rng.choice(names)) for q in (1, 1, 1, 2, 3)] + [(4, "nowhere"), (5, None), (None, "n1"), (1, "n3"), (1, "n3")]
    member = {n: rng.choice(["x", "y", None]) for n in names[:10]}
    got = C.expanded(spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, "query int, node string"), spark.createDataFrame(list(member.items()), "node string, community string"), depth, most).collect()
    want = []
    for q in {q for q, n in seeds if q and n}:
        found = {}
        for s in {n for k, n in seeds if k == q and n}:
            for n, w in ways(edges, s, depth).items():
                found.setdefault(n, []).extend(w)
        rows = sorted((min(w)[0], min(x[1] for x in w), n, min(w)[2]) for n, w in found.items())[:most]
        want += [(q, n, s, h, round(-w, 9), round(-w / (1 + h) + (0.5 if member.get(n) and member.get(n) == member.get(s) else 0), 9)) for w, h, n, s in rows if h]
    assert sorted((r.query, r.node, r.seed, r.hops, round(r.weight, 9), round(r.score, 9)) for r in got) == sorted(want)


def test_expansion_bounds(spark):
    chain = [(f"n{i}", f"n{i + 1}", "calls") for i in range(4)] + [("n2", "n0", "calls")]
    args = spark.createDataFrame(chain, EDGES), spark.createDataFrame([(1, "n0")], "query int, node string"), spark.createDataFrame([], "node string, community string")
    assert {r.node for r in C.expanded(*args).collect()} == {"n1", "n2", "n3"}
    assert C.expanded(spark.createDataFrame([], EDGES), *args[1:]).count() == 0
    with pytest.raises(ValueError):
        C.expanded(*args, 3)


def worth(links, part, g):
    sizes = {}
    for c in part.values():
        sizes[c] = sizes.get(c, 0) + 1
    return sum(w for (a, b), w in links.items() if part[a] == part[b]) - g * sum(n * (n - 1) / 2 for n in sizes.values())


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]
        yield [[items[0]], *rest]


def added(edges):
    links = {}
    for a, b, w in edges:
        if a and b and a != b and w and w > 0:
            links[min(a, b), max(a, b)] = links.get((min(a, b), max(a, b)), 0) + w
    return links


def hangs_together(links, group):
    left, todo = set(group), [group[0]]
    while todo:
        at = todo.pop()
        if at in left:
            left.remove(at)
            todo += [y for e in links for x, y in (e, e[::-1]) if x == at and y in left]
    return not left


@pytest.mark.parametrize("run", range(3))
def test_communities_of_small_graphs(spark, run):
    """Two dense halves and random edges between: never worse than 0.95 of the best of all partitions, always connected."""
    rng = random.Random(run)
    names = [f"n{i}" for i in range(8)]
    edges = [(a, b, 1.0) for a, b in itertools.combinations(names, 2) if rng.random() < (0.9 if (a < "n4") == (b < "n4") else 0.2)] + [("n0", "n0", 9.0), (None, "n1", 1.0), ("n1", "n2", None), ("n1", "n2", -3.0), ("n1", "far", 5.0)]
    links, g = {k: w for k, w in added(edges).items() if "far" not in k}, 0.4
    df = spark.createDataFrame(edges, WEIGHTED)
    rows = C.communities(spark.createDataFrame([(n,) for n in [*names, "n1", None, "alone"]], "node string"), df, g)
    part = {r.node: r.community for r in rows.collect()}
    assert set(part) == {*names, "alone"} and part["alone"] == "alone"
    best = max(worth(links, {n: k for k, p in enumerate(ps) for n in p}, g) for ps in partitions(names))
    mine = worth(links, {n: part[n] for n in names}, g)
    assert best * 0.95 - 1e-9 <= mine <= best + 1e-9
    assert C.quality(df, rows, g).first().quality == pytest.approx(mine)
    groups = {}
    for n, c in part.items():
        groups.setdefault(c, []).append(n)
    assert all(c == min(p) and hangs_together(links, p) for c, p in groups.items())


def test_communities_ties_and_small_ones(spark):
    two = [(a, b, 1.0) for part in ("abcd", "wxyz") for a, b in itertools.combinations(part, 2)] + [("d", "w", 0.3), ("z", "tail", 0.01)]
    nodes = spark.createDataFrame([(n,) for n in [*"abcdwxyz", "tail", "lone"]], "node string")
    df = spark.createDataFrame(two, WEIGHTED)
    first = {r.node: r.community for r in C.communities(nodes, df).collect()}
    assert [first[n] for n in "abcdwxyz"] == list("aaaawwww".replace("w", first["w"])) and first["w"] != "a" and first["tail"] == "tail"
    assert first == {r.node: r.community for r in C.communities(nodes.repartition(3), df.repartition(5).orderBy("weight")).collect()}
    joined = {r.node: r.community for r in C.communities(nodes, df, least=2).collect()}
    assert joined["tail"] == joined["z"] != joined["a"] and joined["lone"] == "lone"
    assert C.communities(nodes.where("false"), df).count() == 0
    assert C.quality(df, nodes.where("false").selectExpr("node", "node as community")).first().quality == 0
    ring = spark.createDataFrame([(f"r{k}", f"r{(k + 1) % 6}", 1.0) for k in range(6)], WEIGHTED)
    got = [r.community for r in C.communities(ring.selectExpr("source as node"), ring, 0.05).collect()]
    assert len(set(got)) == 1
