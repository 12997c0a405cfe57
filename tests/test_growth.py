"""Work that must grow no faster than its tables, and results on the inputs that showed otherwise."""

import math
import random
import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from corpuscle.functions import numeric
from corpuscle.operators import canvas, chunks, communities, patches, postings, prices, relational, retrieval
from corpuscle.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_percentiles_are_solved_in_batches(spark):
    assert "MapInArrow" in plan(catalog.QUERIES["m5_m6_percentile"](spark, SF))
    rows = spark.range(1, 40).select((F.col("id") * 1.0).alias("ms")).withColumn("q", numeric.queue(F.col("ms"), F.lit(5.0), F.lit(1)))
    for share in (0.5, 0.95, 0.9999):
        got = rows.select("ms", numeric.percentile_ms(F.col("q"), share).alias("p")).collect()
        assert all(math.isclose(r.p, -math.log(1 - share) / (1 / r.ms - 0.005), rel_tol=1e-9) for r in got)


def test_source_too_deep_for_the_parser_is_cut_by_lines(spark):
    deep = "not " * 20000 + "x\nprint(1)\n"
    df = spark.createDataFrame([(1, deep, "python"), (2, "import a\n", "python")], "id int, text string, lang string")
    got = chunks.source_chunks(df, "id", "text", "lang").collect()
    assert {r.kind for r in got if r.id == 1} == {"line_window"} and "".join(r.content for r in got if r.id == 1) == deep
    assert [r.kind for r in got if r.id == 2] == ["imports"]


def test_containers_of_many_points_and_boxes(spark):
    points = spark.range(400).select(F.col("id").alias("p"), (F.col("id") % 20 * 3.5).alias("x"), (F.col("id") % 3 * 9.0).alias("y"))
    boxes = spark.range(300).select(F.col("id").alias("b"), (F.col("id") % 7 * 5.0).alias("x0"), (F.col("id") % 3 * 4.0).alias("y0"), (F.col("id") % 7 * 5.0 + F.col("id") % 11 * 6).alias("x1"), (F.col("id") % 5 * 5.0).alias("y1"), (F.col("id") % 40).alias("depth"))
    holds = "x between x0 and x1 and y between y0 and y1"
    want = points.join(boxes, F.expr(holds), "left").groupBy("p").agg(F.max_by("b", F.struct("depth", "b")).alias("b"))
    got = relational.deepest_container(points, boxes, "p", "b", "depth", 10.0).select("p", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    many = relational.deepest_container(points.withColumns({"x": F.lit(1.0), "y": F.lit(1.0)}), boxes.withColumns({"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.lit(5.0), "y1": F.lit(5.0)}), "p", "b", "depth", 10.0)
    assert [r.b for r in many.select("b").distinct().collect()] == [279]
    assert plan(many).split("Join Inner")[1].count("Aggregate") == 2


def test_offered_pairs_are_not_shuffled(spark):
    needs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, None)], "source int, need string")
    nodes = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (4, "b"), (5, None)], "target int, offer string")
    out = relational.offered(needs, nodes, F.lit(None).cast("boolean"), "need", "offer", "source", "target")
    assert sorted(map(tuple, out.collect())) == [(1, 2, "a"), (2, 1, "a")]
    assert "Aggregate" not in plan(out).split("Join Inner")[0] and plan(out).split("Join Inner")[1].count("Aggregate") == 2


def test_offered_pairs_come_in_tiles(spark):
    """Files keep repeated values in little room: both ends come back after a few hundred rows, however many there are."""
    needs = spark.range(620).select(F.concat(F.lit("s"), F.col("id") % 600).alias("source"), F.when(F.col("id") < 619, F.lit(7)).alias("need"))
    nodes = spark.range(700).select(F.concat(F.lit("s"), F.col("id") % 650).alias("target"), F.when(F.col("id") % 100 > 0, F.lit(7)).alias("offer"))
    last = F.substring("source", -1, 1), F.substring("target", -1, 1)
    out = relational.offered(needs, nodes, last[0] == last[1], "need", "offer", "source", "target", last)
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    want = {(f"s{s}", f"s{t}", 7) for s in range(600) for t in {k % 650 for k in range(700) if k % 100} if s % 10 != t % 10}
    assert sorted(tuple(r)[:3] for r in rows) == sorted(want)
    for end in ("source", "target"):
        seen, gaps = {}, []
        for k, r in enumerate(rows):
            gaps += [k - seen[r.task, r[end]]] if (r.task, r[end]) in seen else []
            seen[r.task, r[end]] = k
        assert sorted(gaps)[len(gaps) // 2] <= relational.TILE_TARGETS, end


def test_terms_alike_are_parted_by_further_columns(spark):
    terms = [("p", 1, 1, "Quantity", 5.0, "N"), ("p", 1, 1, "GB-Month", 9.0, "A"), ("p", 1, 1, "GB-Month", 7.0, "A"), ("p", 10, 0, "Hours", 1.0, "A"), ("q", 2, 1, "Hours", 3.0, "R"), ("q", 2, 1, "Quantity", 4.0, "N")]
    for order in (terms, terms[::-1]):
        rows = spark.createDataFrame(order, "sku string, term int, begin int, unit string, usd double, flag string")
        assert sorted(map(tuple, prices.first_tier(rows).collect())) == [("p", "GB-Month", 7.0), ("q", "Quantity", 4.0)]


def test_breaking_rate_of_limits_about_zero(spark, tmp_path):
    kinds = spark.read.parquet(f"{SF}/supplier.parquet").schema
    spark.createDataFrame([(1, "a", 0, -0.01), (2, "b", 0, 0.0), (6, "c", 0, 0.07), (13, "d", 0, None), (10, "e", 0, -0.05)], kinds).write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.id: r.rps for r in catalog.QUERIES["m8_breaking_rate"](spark, str(tmp_path)).collect()}
    assert [got[k] for k in (1, 2, 10, 13)] == [0.0, 0.0, 0.0, None] and abs(got[6] - 0.1) < 1e-9


def test_groups_travel_many_to_a_batch(spark):
    for name in ("w8_merge_small", "d3_d4_patches", "d14_path_latency"):
        text = plan(catalog.QUERIES[name](spark, SF))
        assert "MapInArrow" in text and "GroupsInPandas" not in text, name


def test_chunks_leave_python_in_bounded_batches(spark):
    for name in ("w7_token_chunks", "d19_declarations"):
        assert "MapInArrow" in plan(catalog.QUERIES[name](spark, SF)), name
    ids, rows = pa.array([7, 8]), [(k % 2, 1, 1, "x" * 3000, 1) for k in range(2000)]
    out = list(chunks._tables(ids, iter(rows), 2, [pa.int32(), pa.int32(), pa.string(), pa.int32()], ["id", "a", "b", "content", "n"]))
    assert sum(b.num_rows for b in out) == 2000 and max(b.num_rows for b in out) <= 500 and out[0].column(0).to_pylist()[:2] == [7, 8]


def test_merge_small_by_hand(spark):
    rows = [(1, 1, "p", "a ", 1), (1, 2, "p", "  ", 0), (1, 3, "p", "b c", 2), (1, 4, None, "d", 1), (1, 5, None, "e", 1), (2, 9, "q", "x y z", 3), (2, 8, "q", "w", 1), (None, 1, "r", "v", 1)]
    df = spark.createDataFrame(rows, "doc int, line int, parent string, content string, tokens int")
    got = {tuple(r) for r in chunks.merge_small(df, "doc", "line", "parent", "content", "tokens", 3, 4).collect()}
    assert got == {(1, 1, "p", "a\nb c", 3), (1, 4, None, "d", 1), (1, 5, None, "e", 1), (2, 8, "q", "w\nx y z", 4), (None, 1, "r", "v", 1)}


def test_patches_of_null_and_lone_keys(spark):
    docs = spark.createDataFrame([(1, '{"nodes": [{"id": "a", "kind": "vpc"}]}'), (None, "{}"), (3, "{}")], "doc int, document string")
    ops = spark.createDataFrame([(1, 2, '{"op": "remove_node", "nodeId": "a"}'), (1, 1, '{"op": "set_param", "nodeId": "a", "param": "p", "value": 1}'), (9, 1, "{}")], "doc int, pos int, op string")
    got = {r.doc: (len(r.inverse), r.touched, r.problem) for r in patches.apply_patches(docs, ops).collect()}
    assert got == {1: (2, ["a"], None), None: (0, [], None), 3: (0, [], None)}


def test_bm25_gathers_no_lists(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b", "c"]), (3, None), (4, [])], "id int, t array<string>")
    asked = spark.createDataFrame([(7, ["a", "b"]), (8, ["z"])], "q int, w array<string>")
    out = retrieval.bm25(docs, asked, "id", F.col("t"), "q", F.col("w"), 5)
    assert "collect_list" not in plan(out) and [(r.q, r.id, r["rank"]) for r in out.orderBy("rank").collect()] == [(7, 1, 1), (7, 2, 2)]


def test_bm25_leaves_words_where_they_lie(spark):
    text = plan(catalog.QUERIES["m19_bm25"](spark, SF))
    assert "MapInArrow" in text and not re.search("Generate|LogicalRDD|Repartition|Join", text)


def test_bm25_of_ids_that_repeat_and_of_several_blocks(spark, tmp_path, monkeypatch):
    """Against its SQL: copies, lone and empty texts, texts and queries of one id, few scores and few rows at once."""
    rng = random.Random(9)
    words = [f"{w}{n}" for n in range(12) for w in ("a", "é", "Z")]
    say = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(n % 70, say(rng.choice([0, 1, 3, 3, 40]))) for n in range(90)] + [(71, None), (72, ""), (73, None), (73, "a1 a1 a2"), (None, "a3 Z4"), (None, "a3 a4 Z4")]
    docs += [(100 - n, "a5 é6 Z7") for n in range(20)]
    asked = [(n % 9, say(4)) for n in range(11)] + [(20, "a5 Z7 none"), (21, None), (22, "none"), (23, "a3 a4")]
    for name, rows, kinds in (("documents", docs, "doc_id long, text string"), ("benchmark", asked, "item_id long, text string")):
        spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(map(repr, con.execute(catalog.SQL["m19_bm25"]).fetchall()))
    for terms in (postings.BLOCK_TERMS, 5):
        monkeypatch.setattr(postings, "BLOCK_TERMS", terms)
        assert sorted(repr(tuple(r)) for r in catalog.QUERIES["m19_bm25"](spark, str(tmp_path)).collect()) == want


def test_bm25_of_few_scores_at_once(monkeypatch):
    rng = random.Random(3)
    texts = [[{"t": rng.choices("abcdef", k=rng.randrange(6))} for _ in range(rng.choice([1, 1, 1, 2]))] for _ in range(200)]
    kind = pa.list_(pa.struct([("t", pa.list_(pa.string()))]))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n, n + 40)), pa.array(texts[n : n + 40], kind)], ["id", "texts"]) for n in range(0, 200, 40)]
    block = next(postings.blocks([(7, ["a", "b"]), (8, ["b", "c", "e"]), (9, ["f", "f"]), (10, ["z"])]))
    block.weighed(dict(zip(*next(postings.counted(batches, block)).to_pydict().values())))
    found = []
    for cells in (postings.CELLS, 300, 1):
        monkeypatch.setattr(postings, "CELLS", cells)
        found.append([tuple(r.values()) for b in postings.best(batches, block, 5, pa.int64(), ["q", "id", "score"]) for r in b.to_pylist()])
    assert found[0] == found[1] == found[2] and [r[0] for r in found[0]] == [7] * 5 + [8] * 5 + [9] * 5
    everything = [tuple(r.values()) for b in postings.best(batches, block, 200, pa.int64(), ["q", "id", "score"]) for r in b.to_pylist()]
    assert found[0] == [r for q in (7, 8, 9) for r in sorted((r for r in everything if r[0] == q), key=lambda r: (-r[2], r[1]))[:5]]


def test_expansion_keeps_one_way_a_query_and_node(spark):
    """Nothing is grouped by seed, and a query of as many seeds as are kept walks nowhere."""
    edges = spark.createDataFrame([(f"s{k}", f"p{j}", "calls" if (j + k) % 3 else "imports") for k in range(6) for j in range(9)], "source string, target string, kind string")
    seeds = spark.createDataFrame([(1, f"s{k}") for k in range(6)] + [(2, "s0")], "query int, node string")
    none = spark.createDataFrame([], "node string, community int")
    out = communities.expanded(edges, seeds, none, most=6)
    assert not re.search(r"Aggregate \[query#\d+, seed#", plan(out))
    assert sorted((r.query, r.node, r.seed, r.hops, r.weight) for r in out.collect()) == [(2, f"p{j}", "s0", 1, 1.0) for j in (1, 2, 4, 5, 7)]


def test_drawings_shuffle_a_document_once(spark):
    for name in ("d5_canvas", "d5_problems", "d5_normalised", "d5_round_trip"):
        text = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
        assert "MapInArrow" in text and "ExistingRDD" not in text and text.count("Join") <= (name == "d5_round_trip") * 3, name


def test_problems_of_drawings_shuffle_no_more_than_they_need(spark):
    scan = catalog.QUERIES["d5_problems"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "o_orderkey" in scan and "o_totalprice" not in scan


def test_drawings_of_documents_longer_than_a_batch(spark):
    kinds = "doc string, id string, pos int, kind string, name string, parent string, x double, y double, width double, height double, tier string, params string"
    nodes = [(f"d{d}", f"n{k}", -k, "ecs_service", "N", f"n{k - 1}" if k else None, *[None] * 6) for d, n in enumerate((1, 1300, 2, 499, 1001)) for k in range(n)]
    lines = [(f"d{d}", f"e{k}", k, "calls", f"n{k}", "n0" if d < 4 else "gone", None) for d, n in enumerate((2, 700, 2, 3, 600)) for k in range(1, n)]
    df, edges = spark.createDataFrame(nodes, kinds), spark.createDataFrame(lines, "doc string, id string, pos int, kind string, source string, target string, label string")
    drawing = canvas.to_canvas(df, edges.where("doc <> 'd0'"))
    rows = {(r.doc, r.id): r.place for r in drawing.nodes.collect()}
    assert rows == {(f"d{d}", f"n{k}"): k + 1 for d, n in enumerate((1, 1300, 2, 499)) for k in range(n)}
    assert {(r.doc, r.place) for r in drawing.edges.collect()} == {(f"d{d}", k) for d, n in ((1, 700), (2, 2), (3, 3)) for k in range(1, n)}
    assert {tuple(r) for r in drawing.problems.collect()} == {("d4", f"/edges/e{k}/target", "no such node") for k in range(1, 600)}
    assert canvas.with_clusters(df).groupBy("doc", "kind").count().where("kind = 'ecs_cluster'").count() == 5


def test_what_nodes_stand_in():
    """Against a walk of its own from each node: deep chains, rings, ways into rings, lost parents, repeated ids."""
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 9)
        nodes = [{"id": k if rng.random() < 0.9 else 0, "parent": rng.choice([None, -1, *range(n)]), "kind": rng.choice(["ecs_cluster", "vpc"])} for k in range(n)]
        up = {x["id"]: {y["parent"] for y in nodes if y["id"] == x["id"]} - {None} for x in nodes}
        clusters = {x["id"] for x in nodes if x["kind"] == "ecs_cluster"}
        for start, got in canvas.above(nodes).items():
            seen, todo = set(), list(up[start])
            while todo:
                if (at := todo.pop()) not in seen:
                    seen.add(at)
                    todo += up.get(at, ())
            assert got.cyclic == (start in seen) and got.held == bool((seen - {start}) & clusters)
            if not any(len(x) > 1 for x in up.values()) and not any(k in up and k in _reach(up, k) for k in {start, *seen}):
                assert got.depth == len(seen)
    deep = [{"id": k, "parent": k - 1 if k else None, "kind": "vpc"} for k in range(50_000)]
    assert canvas.above(deep)[49_999].depth == 49_999


def _reach(up, start):
    seen, todo = set(), list(up[start])
    while todo:
        if (at := todo.pop()) not in seen:
            seen.add(at)
            todo += up.get(at, ())
    return seen
