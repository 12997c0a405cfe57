"""Patches of architecture documents: checked, applied and inverted, document by document."""

from __future__ import annotations

import copy
import json

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.batches import in_batches

MOST_OPS = 50


class Refused(ValueError):
    """An operation whose precondition does not hold."""


def _need(found: dict, key: str, what: str) -> dict:
    if key not in found:
        raise Refused(f"{what} {key} is not in the document")
    return found[key]


def _inside(nodes: dict, node: str, of: str) -> bool:
    at, seen = node, set()
    while at is not None and at not in seen:
        if at == of:
            return True
        seen.add(at)
        at = nodes.get(at, {}).get("parent")
    return False


def step(doc: dict, op: dict) -> dict:
    """Applies one operation to ``doc`` (nodes and edges by id) and returns the one that undoes it."""
    nodes, edges, kind = doc["nodes"], doc["edges"], op["op"]
    if kind == "add_node":
        node = op["node"]
        if node["id"] in nodes:
            raise Refused(f"node {node['id']} is already in the document")
        if node.get("parent") is not None:
            _need(nodes, node["parent"], "parent")
        nodes[node["id"]] = {"params": {}, **copy.deepcopy(node)}
        return {"op": "remove_node", "nodeId": node["id"]}
    if kind == "add_edge":
        edge = op["edge"]
        if edge["id"] in edges:
            raise Refused(f"edge {edge['id']} is already in the document")
        for end in ("source", "target"):
            _need(nodes, edge[end], end)
        edges[edge["id"]] = dict(edge)
        return {"op": "remove_edge", "edgeId": edge["id"]}
    if kind == "remove_edge":
        _need(edges, op["edgeId"], "edge")
        return {"op": "add_edge", "edge": edges.pop(op["edgeId"])}
    node = _need(nodes, op["nodeId"], "node")
    if kind == "remove_node":
        for e in edges.values():
            if op["nodeId"] in (e["source"], e["target"]):
                raise Refused(f"edge {e['id']} refers to {op['nodeId']}")
        for n in nodes.values():
            if n.get("parent") == op["nodeId"]:
                raise Refused(f"node {n['id']} is inside {op['nodeId']}")
        return {"op": "add_node", "node": nodes.pop(op["nodeId"])}
    if kind == "set_param":
        if not op.get("param"):
            raise Refused("a parameter without a name")
        old = node["params"].get(op["param"])
        if op.get("value") is None:
            node["params"].pop(op["param"], None)
        else:
            node["params"][op["param"]] = op["value"]
        return {"op": "set_param", "nodeId": op["nodeId"], "param": op["param"], "value": old}
    if kind == "move_node":
        old, new = node.get("parent"), op.get("parent")
        if new is not None:
            _need(nodes, new, "parent")
            if _inside(nodes, new, op["nodeId"]):
                raise Refused(f"{op['nodeId']} would be inside itself")
        node["parent"] = new
        return {"op": "move_node", "nodeId": op["nodeId"], "parent": old}
    if kind == "replace_kind":
        old = {"op": "replace_kind", "nodeId": op["nodeId"], "kind": node["kind"], "params": node["params"]}
        node["kind"], node["params"] = op["kind"], copy.deepcopy(op.get("params") or {})
        return old
    raise Refused(f"unknown operation {kind}")


def touched(op: dict, doc: dict) -> list[str]:
    """Nodes that an operation is about."""
    if op["op"] == "add_edge":
        return [op["edge"]["source"], op["edge"]["target"]]
    if op["op"] == "remove_edge":
        e = doc["edges"].get(op["edgeId"])
        return [e["source"], e["target"]] if e else []
    return [op["node"]["id"] if op["op"] == "add_node" else op["nodeId"]]


def fold(document: str, ops: list[str]) -> tuple[str, list[str], list[str], str | None]:
    """Result, inverse operations in order of use, touched nodes and the refusal, at which all is left as it was."""
    raw = json.loads(document)
    doc = {"nodes": {n["id"]: {"params": {}, **n} for n in raw.get("nodes", [])}, "edges": {e["id"]: e for e in raw.get("edges", [])}}
    if len(ops) > MOST_OPS:
        return document, [], [], f"more than {MOST_OPS} operations"
    back, nodes = [], set()
    try:
        for text in ops:
            op = json.loads(text)
            nodes.update(touched(op, doc))
            back.append(step(doc, op))
    except (Refused, KeyError) as e:
        return document, [], [], str(e)
    out = raw | {"nodes": sorted(doc["nodes"].values(), key=lambda n: n["id"]), "edges": sorted(doc["edges"].values(), key=lambda e: e["id"])}
    return json.dumps(out, sort_keys=True), [json.dumps(o, sort_keys=True) for o in reversed(back)], sorted(nodes), None


def apply_patches(documents: DataFrame, ops: DataFrame, key: str = "doc") -> DataFrame:
    """Each document after its operations: key, document, inverse, touched, problem.

    documents: key, document (JSON). ops: key, pos, op (JSON). Operations of one document depend on each other and are
    folded in order in one go, at most 50 of them; documents are independent, many to a batch. One aggregate brings each
    document and its operations together.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = [[s["op"] for s in sorted(x, key=lambda s: s["pos"])] for x in b.column(2).to_pylist()]
            done = [fold(d, s) for d, s in zip(b.column(1).to_pylist(), steps, strict=True)]
            types = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            columns = [pa.array([x[k] for x in done], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [key, "document", "inverse", "touched", "problem"])

    both = documents.select(key, "document", F.lit(None).alias("step"), F.lit(True).alias("is")).unionByName(ops.select(key, F.lit(None).alias("document"), F.struct("pos", "op").alias("step"), F.lit(False).alias("is")))
    met = both.groupBy(key).agg(F.min_by("document", F.when(F.col("is"), F.lit(0))).alias("document"), F.collect_list("step").alias("steps"), F.max("is").alias("is")).where("is")
    return in_batches(met.select(key, "document", "steps"), run, f"{key} {kind}, document string, inverse array<string>, touched array<string>, problem string")
