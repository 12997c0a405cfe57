"""Operators on small inputs: nulls, ties, empty tables, cycles, round trips."""

import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.operators import chunks, graph, manifest, patches, predict, profile, relational, retrieval
from corpuscle.sources import files
from corpuscle.streaming import events


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ignore_order(spark):
    df = spark.createDataFrame([("a/x.map",), ("keep.map",), ("node_modules/a.js",), ("src/dist/b",), ("b.py",)], "path string")
    out = df.where(~manifest.ignored(F.col("path"), [*manifest.DENIED, "!keep.map"])).collect()
    assert sorted(r.path for r in out) == ["b.py", "keep.map"]


def test_skip_reason_order(spark):
    df = spark.createDataFrame([("a.lock", 9 << 20, b"\0"), ("big", 9 << 20, b"\0"), ("bin", 3, b"a\0b"), ("ok", 3, b"\x10\x01")], "path string, size long, content binary")
    assert [r.w for r in df.select(manifest.skip_reason(F.col("path"), F.col("size"), F.col("content"), manifest.DENIED).alias("w")).collect()] == ["Ignored", "TooLarge", "Binary", None]


def test_merkle_moves_root(spark):
    a = spark.createDataFrame([("x/a", "1"), ("x/y/b", "2"), ("c", "3")], "path string, sha256 string")
    b = a.withColumn("sha256", F.when(F.col("path") == "x/y/b", "9").otherwise(F.col("sha256")))
    one, two = ({r.path: r.hash for r in manifest.merkle(t).collect()} for t in (a, b))
    assert set(one) == {"", "x", "x/y", "x/a", "x/y/b", "c"}
    assert {p for p in one if one[p] != two[p]} == {"", "x", "x/y", "x/y/b"}


def test_diff_empty(spark):
    m = spark.createDataFrame([("a", "1")], "path string, sha256 string")
    assert rows(manifest.diff(m.where("false"), m)) == [("a", "added")] and rows(manifest.diff(m, m)) == [("a", "unchanged")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.", max_size=40), max_size=6), st.integers(1, 9))
def test_chunks_lose_nothing(parts, most):
    source = "\n".join(parts)
    got = list(chunks._greedy(source, most))
    assert "".join(c for _, _, c, _ in got) == source and all(n <= most for *_, n in got)


def test_python_chunks(spark):
    src = "import a\nimport b\nX = 1\n@d\ndef f():\n    pass\nclass C:\n    y = 2\n    def m(self):\n        pass\n"
    df = spark.createDataFrame([(1, src, "python"), (2, "def (", "python"), (3, None, "python"), (4, "", None)], "id int, text string, lang string")
    got = {(r.id, r.kind, r.symbol, r.start_line) for r in chunks.source_chunks(df, "id", "text", "lang").collect()}
    assert got == {(1, "imports", None, 1), (1, "line_window", None, 3), (1, "function", "f", 4), (1, "class", "C", 7), (1, "method", "C.m", 9), (2, "line_window", None, 1)}


def test_vector_topk_limits(spark):
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 0.0])], "id int, v array<double>")
    assert [r.id for r in retrieval.vector_topk(v, [2.0, 0.0], 5, "id", "v").collect()] == [1, 2]
    with pytest.raises(ValueError):
        retrieval.vector_topk(v, [1.0], 0, "id", "v")


def test_match_needs_terms(spark):
    d = spark.createDataFrame([(1, ["a", "b"])], "id int, t array<string>")
    assert retrieval.match_all(d, F.col("t"), F.array().cast("array<string>")).count() == 0


def test_topk_plan_is_bounded(spark, capsys):
    v = spark.createDataFrame([(1, [1.0])], "id int, v array<double>")
    retrieval.vector_topk(v, [1.0], 2, "id", "v").explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_either_end_has_no_nested_loop(spark, capsys):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 1)], "s int, t int")
    n = spark.createDataFrame([(1,)], "n int")
    out = relational.either_end(e, n, "n", "s", "t")
    assert rows(out) == [(1, 1), (1, 2)]
    out.explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_longest_prefix(spark):
    names = spark.createDataFrame([("a/b/c",), ("ab/c",), (None,)], "name string")
    known = spark.createDataFrame([("a",), ("a/b",), ("b",)], "p string")
    assert {r.name: r.p for r in relational.longest_prefix(names, known, "name", "p").collect()} == {"a/b/c": "a/b", "ab/c": None, None: None}


def test_only_match(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, k string")
    o = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2)], "k string, v int")
    assert rows(relational.only_match(a, o, ["k"], "id", ["v"]).select("id", F.coalesce("v", F.lit(-1)))) == [(1, 1), (2, -1), (3, -1)]


def test_upsert_and_prefer(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, o int")
    assert rows(relational.upsert(t, c, ["k"], "o")) == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(relational.prefer(t, c.select("k", "v").where("k = 3"), ["k"])) == [(1, "a"), (2, "b"), (3, "z")]


def test_insert_unique_fails_whole(spark, tmp_path):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        files.insert_unique(df, str(tmp_path / "t"), ["k"])
    assert not (tmp_path / "t").exists()


def test_scan_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"abc")
    (tmp_path / "y").write_bytes(b"0123456789")
    assert {(r.path, r.size_bytes) for r in files.scan_tree(spark, str(tmp_path)).collect()} == {("a/x.txt", 3), ("y", 10)}
    assert [r.path for r in files.scan_tree(spark, str(tmp_path), 5).collect()] == ["a/x.txt"]


def test_neighbourhood(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "d", "y")], "s string, t string, k string")
    seeds = spark.createDataFrame([("a",)], "n string")
    assert rows(graph.neighbourhood(e, seeds, "n", 3, "s", "t")) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.neighbourhood(e, seeds, "n", 3, "s", "t", "k", ["x"])) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(graph.neighbourhood(e, seeds, "n", 3, "s", "t", "k", [])) == [("a", 0)]
    with pytest.raises(ValueError):
        graph.neighbourhood(e, seeds, "n", 4, "s", "t")


def test_ancestors_and_cycles(spark):
    t = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 4), (7, 7)], "id int, p int")
    assert (3, 1, 2) in rows(graph.ancestors(t, "id", "p")) and (4, 5, 1) in rows(graph.ancestors(t, "id", "p"))
    assert rows(graph.in_cycle(t, "id", "p")) == [(4,), (5,), (7,)]
    assert [r.id for r in graph.parents_first(t.where("id < 4"), "id", "p", "id").collect()] == [1, 2, 3]


def test_path_latency_is_linear_in_means(spark):
    from corpuscle.functions import numeric

    r = spark.createDataFrame([("p", 0, None, "a", 10.0, 20.0), ("p", 1, 0, "b", 5.0, 20.0), ("p", 1, 1, "c", 5.0, 20.0), ("q", 0, None, "a", 10.0, 20.0)], "path string, pos int, branch int, id string, ms double, rps double")
    r = r.withColumn("queue", numeric.queue(F.col("ms"), F.col("rps"), F.lit(1))).withColumn("p99", numeric.percentile_ms(F.col("queue"), 0.99)).withColumn("step", F.lit(0))
    out = {x.path: x for x in predict.path_latency(r.drop("ms", "rps")).collect()}
    assert abs(out["q"].mean_ms - 12.5) < 1e-9 and abs(out["q"].p95_ms - 12.5 * 2.9957) < 0.2
    assert out["p"].mean_ms > 12.5 + 1000 / 180 and out["p"].p50_ms <= out["p"].p95_ms <= out["p"].p99_ms


def test_composite(spark):
    m = spark.createDataFrame([("a", "g", 1, 0.9), ("b", "g", 2, 0.9)], "id string, group string, zone int, availability double")
    out = predict.composite(m, 0.0).first()
    assert abs(out.composite - 0.99) < 1e-12 and out.weakest == "a"
    assert abs(predict.composite(m, 1.0).first().composite - 0.9) < 1e-12
    assert predict.composite(m.where("false")).first().composite == 1.0


def test_verify(spark):
    c = spark.createDataFrame([(1, "Two", "f", 2, 2, "h"), (2, "two", "f", 2, 2, "old"), (3, "x", "f", 9, 9, "h"), (4, "x", "f", 1, 3, "h"), (5, "x", "g", 1, 1, "h"), (6, "x", "f", 3, 1, "h")], "id int, claim string, path string, start_line int, end_line int, sha256 string")
    f = spark.createDataFrame([("f", "h")], "path string, file_sha string")
    k = spark.createDataFrame([("f", 1, "one\ntwo"), ("f", 3, "three")], "path string, c_start int, content string")
    assert rows(profile.verify(c, f, k)) == [(1, "supported"), (2, "span_changed"), (3, "span_missing"), (4, "unsupported"), (5, "span_missing"), (6, "span_missing")]


BASE = {"nodes": [{"id": "a", "kind": "vpc", "parent": None, "params": {}}, {"id": "b", "kind": "rds", "parent": "a", "params": {"n": 1}}], "edges": []}
OPS = st.one_of(
    st.builds(lambda n, v: {"op": "set_param", "nodeId": n, "param": "n", "value": v}, st.sampled_from("ab"), st.one_of(st.none(), st.integers())),
    st.builds(lambda i: {"op": "add_node", "node": {"id": i, "kind": "x", "parent": "a"}}, st.sampled_from("cdb")),
    st.builds(lambda i: {"op": "remove_node", "nodeId": i}, st.sampled_from("abcd")),
    st.builds(lambda i, s, t: {"op": "add_edge", "edge": {"id": i, "source": s, "target": t}}, st.sampled_from("xy"), st.sampled_from("abc"), st.sampled_from("abc")),
    st.builds(lambda i: {"op": "remove_edge", "edgeId": i}, st.sampled_from("xy")),
    st.builds(lambda i, p: {"op": "move_node", "nodeId": i, "parent": p}, st.sampled_from("abc"), st.sampled_from([None, "a", "b", "c"])),
    st.builds(lambda i: {"op": "replace_kind", "nodeId": i, "kind": "k", "params": {"z": 1}}, st.sampled_from("abc")),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(OPS, max_size=8))
def test_patches_invert(ops):
    start = patches.fold(json.dumps(BASE), [])[0]
    out, back, _, problem = patches.fold(start, [json.dumps(o) for o in ops])
    if problem:
        assert out == start
    else:
        assert patches.fold(out, back)[0] == start


def test_frames(spark):
    raw = ["data: {\"text\":\ndata: \"hi\"}\nevent: token\nid: m:1\n: c", ": only", "event: zz\ndata: {}\nid: m:2", "event: token\ndata: {bad\nid: m:3", "event: done\nid: m:4"]
    got = events.decode_events(events.parse_frames(spark.createDataFrame([(r,) for r in raw], "frame string"))).select("message_id", "seq", "kind", "text")
    assert rows(got) == [("m", 1, "token", "hi"), ("m", 4, "done", "")]


def test_message_states_stream(spark, tmp_path):
    cols = "message_id string, seq long, kind string, text string, verified boolean, call_id string, ok boolean, summary string, proposal_id string, message string, finish string"
    blank = (False, "", False, "", "", "", "")
    part = [[("m", 2, "token", "b", *blank), ("m", 1, "token", "a", *blank)], [("m", 2, "token", "b", *blank), ("m", 3, "done", "", False, "", False, "", "", "", "complete")]]
    for k, p in enumerate(part):
        spark.createDataFrame(p, cols).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    flat = tmp_path / "flat"
    flat.mkdir()
    for k in range(2):
        next((tmp_path / "in" / str(k)).glob("*.parquet")).rename(flat / f"{k}.parquet")
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(flat))
    q = events.message_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.sql("select * from states order by last_seq desc").first()
    assert (last.content, last.status, last.last_seq) == ("ab", "complete", 3)


def test_rate_limit_stream_has_watermark(spark):
    r = spark.readStream.format("rate").load().withColumn("k", F.lit(1))
    assert events.rate_limited(r, "k", "timestamp", {"1 minute": 5}, late="5 minutes").isStreaming


def test_bottlenecks_and_percentiles_against_columns(spark):
    """The array forms against the column expressions, row by row."""
    from corpuscle.functions import numeric
    from corpuscle.operators import predict

    rows = spark.createDataFrame([(k, str(k % 3), k % 8 + 1, float(k % 40), float(k * 7 % 900)) for k in range(300)], "id long, service string, servers int, service_ms double, rps double")
    limits = spark.createDataFrame([("a", "0", 100.0), ("b", "1", 50.0), ("c", "*", 1000.0), ("d", "2", 0.0), ("e", "*", 1e12), ("f", "*", None)], "limit_id string, service string, value double")
    got = {(r.id, r.limit_id): r.breaking_rps for r in predict.bottlenecks(rows, limits).collect()}
    usage = lambda rps: rps * numeric.queue(F.col("service_ms"), rps, F.col("servers"))["total_ms"] / 1000
    both = rows.alias("r").join(limits.alias("l"), (F.col("l.service") == F.col("r.service")) | (F.col("l.service") == "*"))
    want = {(r.id, r.limit_id): r.b for r in both.select("id", "limit_id", numeric.breaking_rate(usage, F.col("value")).alias("b")).where("b is not null and limit_id <> 'f'").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    queues = rows.withColumn("queue", numeric.queue(F.col("service_ms"), F.col("rps") / 10, F.col("servers")))
    out = predict.with_percentile(queues, "queue", 0.99, "p").select("id", "p", numeric.percentile_ms(F.col("queue"), 0.99).alias("w")).collect()
    assert len(out) == 300 and all(abs(r.p - r.w) <= 1e-6 * max(1.0, r.w) for r in out)


def test_parallel_branches_take_the_slowest(spark):
    from corpuscle.functions import numeric
    from corpuscle.operators import predict

    rows = spark.createDataFrame([("x", 0, None, 0, "a", 5.0), ("x", 1, 0, 0, "b", 10.0), ("x", 1, 1, 0, "c", 30.0)], "path string, pos int, branch int, step int, id string, ms double")
    seg = rows.withColumn("queue", numeric.queue(F.col("ms"), F.lit(1.0), F.lit(1)))
    got = predict.path_latency(predict.with_percentile(seg, "queue", 0.99, "p99")).first()
    rng = np.random.default_rng(2)
    t = [rng.exponential(1 / (1000 / m - 1) * 1000, 400_000) for m in (5.0, 10.0, 30.0)]  # M/M/1: exponential of rate mu - lambda
    total = t[0] + np.maximum(t[1], t[2])
    assert abs(got.mean_ms / total.mean() - 1) < 0.02 and abs(got.p95_ms / np.quantile(total, 0.95) - 1) < 0.02


def test_deep_trees(spark):
    from corpuscle.operators import graph

    chain = [(k, k - 1 if k else None) for k in range(90)] + [(200, 201), (201, 200)]
    tree = spark.createDataFrame(chain, "id long, parent long")
    assert sorted(r.node for r in graph.in_cycle(tree, "id", "parent").collect()) == [200, 201]
    up = graph.ancestors(tree.where("id < 90"), "id", "parent")
    assert up.count() == 90 * 89 // 2 and up.agg(F.max("hops")).first()[0] == 89


def test_snapshots_replace_the_state(spark):
    from corpuscle.streaming import events

    message = '{"seq": 3, "message": {"content": "whole", "status": "complete", "citations": [{"verified": true}, {}], "unverifiedCitations": 1, "toolCalls": [{"callId": "a", "ok": true}, {"callId": "b"}], "proposal": {"proposalId": "p"}}}'
    rows = [("m", "1", "token", '{"seq": 1, "text": "part"}'), ("m", "3", "snapshot", message), ("m", "4", "token", '{"seq": 4, "text": "!"}'), ("m", "5", "tool_result", '{"seq": 5, "callId": "b", "ok": true}')]
    frames = spark.createDataFrame(rows, "message_id string, id string, event string, data string")
    got = events.message_states(events.decode_events(frames)).first()
    assert (got.content, got.status, got.citations, got.unverified, got.tool_calls, got.tools_done, got.proposal, got.last_seq) == ("whole!", "complete", 2, 1, 2, 2, "p", 5)


def test_delta_counts_what_stayed(spark):
    from corpuscle.operators import relational

    out = relational.delta(spark.range(0, 5), spark.range(2, 7)).collect()
    assert sorted((r.id, r.state) for r in out if r.id is not None) == [(0, "resolved"), (1, "resolved"), (5, "appeared"), (6, "appeared")]
    assert [r.state for r in out if r.id is None] == ["unchanged 3"]


def test_snapshots_are_filed_under_their_message(spark, tmp_path):
    """A frame without an id, or numbered anew, describes the message that it holds."""
    from corpuscle.streaming import events

    whole = '{"message": {"id": "m", "content": "whole", "status": "complete"}}'
    rows = [("m", "m:7", "token", '{"text": "part"}'), (None, None, "snapshot", whole), ("n", "n:1", "token", '{"text": "other"}')]
    decoded = events.decode_events(spark.createDataFrame(rows, "message_id string, id string, event string, data string"))
    got = {r.message_id: r.content for r in events.message_states(decoded).collect()}
    assert got == {"m": "wholepart", "n": "other"}  # in a batch by number, 0 first
    decoded.where("kind = 'token'").write.parquet(str(tmp_path / "in"))
    decoded.where("kind = 'snapshot'").write.mode("append").parquet(str(tmp_path / "late"))
    stream = spark.readStream.schema(decoded.schema).parquet(str(tmp_path / "in"))
    query = events.message_states(stream).writeStream.format("memory").queryName("filed").outputMode("update").option("checkpointLocation", str(tmp_path / "at")).start()
    query.processAllAvailable()
    for part in (tmp_path / "late").glob("*.parquet"):
        part.rename(tmp_path / "in" / part.name)
    query.processAllAvailable()
    query.stop()
    states = {}
    for r in spark.table("filed").collect():
        states.setdefault(r.message_id, []).append((r.content, r.status, r.last_seq))
    assert states == {"m": [("part", "streaming", 7), ("whole", "complete", 7)], "n": [("other", "streaming", 1)]}
