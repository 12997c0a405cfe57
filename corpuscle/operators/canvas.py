"""Architecture documents and their drawings: each way, and the normal form of either, for all documents at once.

Nodes of a document: doc, id, pos, kind, name, parent, x, y, width, height, tier, params. Edges: doc, id, pos, kind, source, target, label.
Positions are relative to the parent in both forms, so that moving a container changes one node.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from corpuscle.operators.batches import BATCH_ROWS, in_batches
from corpuscle.operators.layout import CLUSTER_HEIGHT, CLUSTER_WIDTH, SERVICE_X, SERVICE_Y

#: What each kind of resource is drawn as. A subnet's tier picks its own; kinds not named have no shape.
SERVICE_BY_KIND = {
    "vpc": "vpc-environment", "subnet": "public-subnet", "nat_gateway": "nat-gateway", "security_group": "security-group", "ec2_instance": "ec2", "lambda_function": "lambda", "ecs_cluster": "ecs-cluster",
    "ecs_service": "ecs", "alb": "alb", "nlb": "nlb", "api_gateway": "api-gateway", "cloudfront_distribution": "cloudfront", "route53_zone": "route53", "s3_bucket": "s3", "rds_instance": "rds", "dynamodb_table": "dynamodb",
    "elasticache_cluster": "elasticache", "sns_topic": "sns", "sqs_queue": "sqs", "iam_role": "iam", "cognito_user_pool": "cognito", "cloudwatch_log_group": "cloudwatch", "secretsmanager_secret": "secrets-manager",
}

NODE = "doc id pos kind name parent x y width height tier params".split()
EDGE = "doc id pos kind source target label".split()


class Drawing(NamedTuple):
    """nodes, edges: of documents without a problem, with ``place``. problems: doc, pointer, message of the others."""

    nodes: DataFrame
    edges: DataFrame
    problems: DataFrame


def service_of(kind: Column, tier: Column) -> Column:
    """The catalog's name for a node; null if it cannot be drawn."""
    table = F.create_map(*(F.lit(x) for kv in SERVICE_BY_KIND.items() for x in kv))
    return F.when(kind == "subnet", F.when(tier == "public", "public-subnet").otherwise("private-subnet")).otherwise(F.try_element_at(table, kind))


def shape_of(kind: Column, tier: Column) -> Column:
    """A container's own shape, ``service`` for all others."""
    return F.when(kind.isin("vpc", "subnet", "ecs_cluster"), service_of(kind, tier)).otherwise("service")


def rounded(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5).cast("long")


def _documents(rows: DataFrame, of: Callable[[pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """``of`` whole documents' rows, a document's together: one shuffle by document, sorted there. Rows stay in Arrow; beside
    a batch's own documents no more than the one that goes on into the next is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            docs = b.column("doc").to_pylist()
            last = next((k for k in range(len(docs) - 1, 0, -1) if docs[k] != docs[k - 1]), 0)
            if last or held and held[-1].column("doc")[-1].as_py() != docs[0]:
                yield from of(pa.Table.from_batches([*held, b.slice(0, last)])).to_batches(BATCH_ROWS)
                held = []
            held.append(b.slice(last))
        if held:
            yield from of(pa.Table.from_batches(held)).to_batches(BATCH_ROWS)

    return in_batches(rows.repartition("doc").sortWithinPartitions("doc"), run, schema)


def _values(column: pa.ChunkedArray) -> list:
    """As ``to_pylist``, which is slow for strings."""
    return column.to_numpy().tolist() if pa.types.is_string(column.type) else column.to_pylist()


def _by_document(rows: pa.Table, names: list[str], of: str | None = None) -> dict[object, list[dict]]:
    """By doc the rows, or those where the struct ``of`` is not null, with these columns or fields alone and ``at``, their place in the table."""
    place, found = range(rows.num_rows), {}
    if of:
        kept = rows.column(of).is_valid()
        place, rows = pc.indices_nonzero(kept).to_pylist(), rows.filter(kept)
    docs, names = _values(rows.column("doc")), [*names, "at"]
    columns = [pc.struct_field(rows.column(of), c) if of else rows.column(c) for c in names[:-1]]
    for doc, row in zip(docs, zip(*map(_values, columns), place, strict=True), strict=True):
        found.setdefault(doc, []).append(dict(zip(names, row)))  # noqa: B905
    return found


class Above(NamedTuple):
    """What a node stands in: held, whether a cluster is above it; depth, levels above it; cyclic, whether its parents lead back to it."""

    held: bool
    depth: int
    cyclic: bool


def above(nodes: list[dict]) -> dict[object, Above]:
    """``Above`` by id for the nodes of one document, in time linear in them where no id is repeated. Parents that no node
    declares hold nothing; of a repeated id all parents count, and its depth is none."""
    up: dict[object, set] = {}
    for n in nodes:
        if n["id"] is not None:
            up.setdefault(n["id"], set()).update([] if n["parent"] is None else [n["parent"]])
    clusters = {n["id"] for n in nodes if n["kind"] == "ecs_cluster"}
    told: dict[object, Above] = {}
    if any(len(x) > 1 for x in up.values()):
        for start in up:
            seen, level = set(), [start]
            while level:
                level = list({p for i in level for p in up.get(i, ())} - seen)
                seen.update(level)
            told[start] = Above(not clusters.isdisjoint(seen - {start}), 0, start in seen)
        return told
    parent = {i: next(iter(x), None) for i, x in up.items()}
    for start in up:
        way: dict[object, int] = {}
        at = start
        while at in parent and at not in told and at not in way:
            way[at] = len(way)
            at = parent[at]
        path = list(way)
        if at in way:  # a ring: each of its nodes stands in all others
            ring = path[way[at] :]
            inside = sum(i in clusters for i in ring)
            told.update((i, Above(inside > (i in clusters), 0, True)) for i in ring)
            path = path[: way[at]]
        for i in reversed(path):
            p = parent[i]
            over = told.get(p, Above(False, 0, False))
            told[i] = Above(False, 0, False) if p is None else Above(p in clusters or over.held, over.depth + 1, False)
    return told


def with_clusters(nodes: DataFrame) -> DataFrame:
    """Nodes, and for each service without a cluster above it one of its own before it, in its place: ``pos`` becomes (pos, part).

    The service moves into the cluster and is placed from its origin. Done again, it changes nothing.
    """
    nodes = nodes.select(NODE)

    def look(rows: pa.Table) -> pa.Table:
        held = [False] * rows.num_rows
        for doc, own in _by_document(rows, ["id", "kind", "parent"]).items():
            found = above(own) if doc is not None else {}
            for n in own:
                held[n["at"]] = n["id"] in found and found[n["id"]].held
        return rows.append_column("held", pa.array(held, pa.bool_()))

    rows = _documents(nodes, look, StructType([*nodes.schema, StructField("held", BooleanType())]))
    alone = (F.col("kind") == "ecs_service") & ~F.col("held")
    own, c = F.concat("id", F.lit("-cluster")), F.col
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    none = F.lit(None)
    node = lambda **v: F.struct(*(v.get(k, c(k)).cast(nodes.schema[k].dataType).alias(k) for k in NODE), v.get("part", F.lit(1)).alias("part"))
    cluster = node(id=own, kind=F.lit("ecs_cluster"), name=F.concat("name", F.lit(" cluster")), x=x, y=y, width=F.lit(CLUSTER_WIDTH), height=F.lit(CLUSTER_HEIGHT), tier=none, params=none, part=F.lit(0))
    moved = node(parent=own, x=F.lit(SERVICE_X), y=F.lit(SERVICE_Y))
    return rows.select(F.explode(F.when(F.coalesce(alone, F.lit(False)), F.array(cluster, moved)).otherwise(F.array(node()))).alias("n")).select("n.*")


def problems(nodes: list[dict], edges: list[dict], over: dict[object, Above], drawn: bool) -> set[tuple[str, str]]:
    """pointer, message for one document: repeated ids, ends and parents that no node declares, edges from a node to itself,
    containment cycles and, where it is to be ``drawn``, kinds without a shape."""
    ids, out = {n["id"] for n in nodes}, set()
    for part, rows in (("nodes", nodes), ("edges", edges)):
        out |= {(f"/{part}/{i}", "repeated id") for i, n in Counter(r["id"] for r in rows).items() if n > 1}
    for n in nodes:
        if n["parent"] is not None and n["parent"] not in ids:
            out.add((f"/nodes/{n['id']}/parent", "no such node"))
        if over[n["id"]].cyclic:
            out.add((f"/nodes/{n['id']}/parent", "containment cycle"))
        if drawn and n["kind"] not in SERVICE_BY_KIND:
            out.add((f"/nodes/{n['id']}/kind", "no shape"))
    for e in edges:
        out |= {(f"/edges/{e['id']}/{end}", "no such node") for end in ("source", "target") if e[end] not in ids}
        if e["source"] is not None and e["source"] == e["target"]:
            out.add((f"/edges/{e['id']}", "from a node to itself"))
    return out


def _nulls_first(*values) -> tuple:
    return tuple((x is not None, x if x is not None else 0) for x in values)


def _in_order(nodes: list[dict], over: dict[object, Above], drawn: bool) -> list[dict]:
    """Nodes of a sound document as they come in a drawing, or else by pos and part."""
    if not drawn:
        return sorted(nodes, key=lambda n: _nulls_first(n["pos"], n["part"], n["id"]))
    first = {n["id"]: n["pos"] for n in nodes}
    for n in sorted(nodes, key=lambda n: -over[n["id"]].depth):  # inner ones tell outer ones
        p, pos = n["parent"], first[n["id"]]
        if p is not None and pos is not None:
            first[p] = pos if first[p] is None else min(first[p], pos)
    return sorted(nodes, key=lambda n: _nulls_first(first[n["id"]], over[n["id"]].depth, n["pos"], n["id"]))


def _sound(nodes: DataFrame, edges: DataFrame, drawn: bool) -> Drawing:
    """What has no problem, with ``__place`` in its order, and the problems. Rows without a doc or id are no one's.

    A document's nodes and edges meet in one shuffle, and are judged and put in order together.
    """
    nodes, edges = nodes.where("doc is not null and id is not null"), edges.where("doc is not null and id is not null")
    keys = [c for c in nodes.columns if c in ("id", "pos", "part", "kind", "parent")]
    ends = ["id", "pos", "source", "target"]

    def together(part: list[str], line: list[str]) -> DataFrame:
        n, e = (df.select(F.struct(*(c for c in df.columns if c in own and c != "doc")).alias("x")) for df, own in ((nodes, part), (edges, line)))
        none = lambda df: F.lit(None).cast(df.schema["x"].dataType)
        return nodes.select("doc", F.struct(*n.schema["x"].dataType.names).alias("n"), none(e).alias("e")).unionByName(edges.select("doc", none(n).alias("n"), F.struct(*e.schema["x"].dataType.names).alias("e")))

    def judge(table: pa.Table, part: list[str], line: list[str]) -> Iterator[tuple[object, list[dict], list[dict], dict, set]]:
        mine, lines = _by_document(table, part, "n"), _by_document(table, line, "e")
        for doc in {**mine, **lines}:
            own, out = mine.get(doc, []), lines.get(doc, [])
            over = above(own)
            yield doc, own, out, over, problems(own, out, over, drawn)

    def placed(k: str) -> DataFrame:
        """The nodes or edges of sound documents with ``__place``."""

        def of(table: pa.Table) -> pa.Table:
            at: list[int] = []
            place: list[int] = []
            for _, own, out, over, found in judge(table, keys, ends):
                if not found:
                    rows = _in_order(own, over, drawn) if k == "n" else sorted(out, key=lambda r: _nulls_first(r["pos"], r["id"]))
                    at += (r["at"] for r in rows)
                    place += range(1, len(rows) + 1)
            return table.select(["doc", k]).take(pa.array(at, pa.int64())).append_column("place", pa.array(place, pa.int32()))

        df, rows = {"n": nodes, "e": edges}[k], together(nodes.columns, edges.columns)
        found = _documents(rows, of, StructType([rows.schema["doc"], rows.schema[k], StructField("place", IntegerType())]))
        return found.select(*(c if c == "doc" else F.col(k)[c].alias(c) for c in df.columns), F.col("place").alias("__place"))

    def told(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([{"doc": doc, "pointer": p, "message": m} for doc, *_, found in judge(table, part, line) for p, m in sorted(found)], arrow)

    # problems need no more than who stands where
    part, line = ["id", "kind", "parent"], ["id", "source", "target"]
    rows = together(part, line)
    schema = StructType([rows.schema["doc"], StructField("pointer", StringType()), StructField("message", StringType())])
    arrow = to_arrow_schema(schema)
    return Drawing(placed("n"), placed("e"), _documents(rows, told, schema))


def _placed(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(*order)))


def to_canvas(nodes: DataFrame, edges: DataFrame) -> Drawing:
    """Documents as drawings. Nodes: doc, id, place, shape, parent, x, y, width, height, kind, name, tier, params, service.

    Parents come before children: a node comes when the first node in it or itself comes in the document, outer ones
    first. A missing position is 0; a size counts only if it is whole. A document with a problem is not drawn at all.
    """
    good = _sound(nodes, edges, True)
    kind, tier = F.col("kind"), F.col("tier")
    whole = F.col("width").isNotNull() & F.col("height").isNotNull()
    drawn = good.nodes.select(
        "doc", "id", F.col("__place").alias("place"), shape_of(kind, tier).alias("shape"), "parent", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), F.when(whole, F.col("width")).alias("width"), F.when(whole, F.col("height")).alias("height"),
        "kind", "name", "tier", "params", service_of(kind, tier).alias("service"))
    return Drawing(drawn, good.edges.withColumn("place", F.col("__place")).drop("__place"), good.problems)


def to_document(nodes: DataFrame, edges: DataFrame) -> Drawing:
    """Drawings as documents: places become whole numbers, and services without a cluster get theirs. ``place`` is the order, and ``pos``."""
    whole = nodes.withColumns({c: rounded(F.col(c)).cast("double") for c in ("x", "y", "width", "height")}).withColumn("pos", F.col("place"))
    good = _sound(with_clusters(whole), edges.withColumn("pos", F.col("place")), False)
    return Drawing(good.nodes.withColumns({"place": F.col("__place"), "pos": F.col("__place")}).drop("part", "__place"), good.edges.drop("__place"), good.problems)


def normalised(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The normal form of documents: clusters supplied, by id, whole places, 0 where there is none. Twice is once."""
    rows = with_clusters(nodes).withColumns({c: rounded(F.coalesce(c, F.lit(0.0))).cast("double") for c in ("x", "y")})
    rows = _placed(rows, "id").withColumn("pos", F.col("place"))
    lines = _placed(edges, "id").withColumn("pos", F.col("place"))
    return rows.select(*NODE, "place"), lines.select(*EDGE, "place")
