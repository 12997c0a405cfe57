"""Prefix trie of conversations by an external mergesort whose runs carry longest common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.llm.common import in_batches, keep

#: Bytes of a turn's digest: all that sorting sees of its role and text.
SYMBOL = 16
#: Turns that one sorted range holds, about, and turns of one run in it.
RANGE_TURNS, RUN_TURNS = 500_000, 20_000
#: Ids in one stored row of a long list.
LIST_IDS = 8192

_SCHEMA = "kind string, range int, slot long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path binary, parent_path binary, is_first boolean, is_last boolean, length long, ids string"
_ARROW = pa.schema([("kind", pa.string()), ("range", pa.int32()), *((c, pa.int64()) for c in "slot conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens".split()),
                    ("ends_sha256", pa.string()), ("path", pa.binary()), ("parent_path", pa.binary()), ("is_first", pa.bool_()), ("is_last", pa.bool_()), ("length", pa.int64()), ("ids", pa.string())])
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@dataclass(slots=True)
class Sequence:
    """A conversation in a run: its turns' digests in a row, their lengths, and how many turns it shares with the one before."""

    key: bytes
    conv: int
    lengths: list[int]
    lcp: int = 0

    def __len__(self) -> int:
        return len(self.key) // SYMBOL


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two sequences begin with alike, of which ``known`` are known to be alike."""
    most, at = min(len(a), len(b)) // SYMBOL, known
    while at < most and a[at * SYMBOL : (at + 1) * SYMBOL] == b[at * SYMBOL : (at + 1) * SYMBOL]:
        at += 1
    return at


def sorted_run(rows: list[Sequence]) -> list[Sequence]:
    """Sorts a run by turns, then by id, and gives every sequence its common prefix with the one before it."""
    rows.sort(key=lambda s: (s.key, s.conv))
    for before, s in zip(rows, rows[1:], strict=False):
        s.lcp = shared(before.key, s.key)
    return rows


class LoserTree:
    """Merges sorted runs. Each head knows its common prefix with the last sequence put out.

    Of two heads the one that shares more with that sequence comes first, without a look at either; only heads that
    share equally much are compared, from the first turn that nobody has compared yet, and the loser keeps what they share.
    """

    def __init__(self, runs: list[list[Sequence]]):
        self.runs = [iter(r) for r in runs]
        self.compared = 0  # turns looked at
        size = 1
        while size < max(1, len(runs)):
            size *= 2
        self.heads: list[Sequence | None] = [next(r, None) for r in self.runs] + [None] * (size - len(runs))
        self.lcp = [0] * size
        self.losers = [-1] * size
        self.size = size
        self.top = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.lcp[a] != self.lcp[b]:
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        known = self.lcp[a]
        both = shared(x.key, y.key, known)
        self.compared += both - known + 1
        at = slice(both * SYMBOL, (both + 1) * SYMBOL)
        winner, loser = (a, b) if (x.key[at], x.conv) <= (y.key[at], y.conv) else (b, a)
        self.lcp[loser] = both
        return winner, loser

    def __iter__(self) -> Iterator[tuple[Sequence, int]]:
        """Every sequence in order, with the turns it shares with the one put out before."""
        while (s := self.heads[self.top]) is not None:
            yield s, self.lcp[self.top]
            winner = self.top
            self.heads[winner] = next(self.runs[winner], None)
            self.lcp[winner] = self.heads[winner].lcp if self.heads[winner] is not None else 0
            node = (winner + self.size) // 2
            while node:
                winner, self.losers[node] = self._play(winner, self.losers[node])
                node //= 2
            self.top = winner


@dataclass(slots=True)
class Node:
    """An open node of the path."""

    depth: int
    length: int
    first: bool  # on the path of the range's first sequence
    path: bytes
    n_convs: int = 0
    conv: int | None = None
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    ends: list[int] = field(default_factory=list)
    waiting: list[list] = field(default_factory=list)  # finished children, until this one's id is known
    slot: int | None = None


class OpenPath:
    """Turns a sorted stream into nodes. Those that another range may hold too come out in parts, as ``edge`` rows."""

    def __init__(self, number: int):
        self.number, self.stack, self.out, self.slots, self.begun = number, [], [], 0, False

    def put(self, s: Sequence, lcp: int) -> None:
        if not self.begun:
            self._open(0, None)
        while len(self.stack) - 1 > lcp:
            self._close(last=False)
        for d in range(len(self.stack), len(s) + 1):
            self.stack[-1].n_children += 1
            self._open(s.lengths[d - 1], s.key[(d - 1) * SYMBOL : d * SYMBOL])
        top = self.stack[-1]
        top.n_convs += 1
        top.conv = s.conv if top.conv is None else min(top.conv, s.conv)
        top.ends.append(s.conv)
        self.begun = True

    def _open(self, length: int, symbol: bytes | None) -> None:
        path = hashlib.sha256(self.stack[-1].path + symbol).digest()[:SYMBOL] if symbol is not None else b""
        node = Node(len(self.stack), length, not self.begun, path)
        if node.first:
            node.slot, self.slots = self.slots, self.slots + 1
        self.stack.append(node)

    def _close(self, last: bool) -> None:
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        if not node.n_children:
            node.n_leaves = 1
        node.saved += (node.n_convs - 1) * node.length
        if above is not None:
            above.n_convs += node.n_convs
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
            above.n_leaves += node.n_leaves
            above.saved += node.saved
        if last and node.slot is None:
            node.slot, self.slots = self.slots, self.slots + 1
        edge = node.slot is not None
        for child in node.waiting:  # what a range's edge left open is known only when all ranges are
            child[2], child[5] = (node.slot, None) if edge else (None, node.conv)
            self.out.append(child)
        values = [node.conv, node.depth, None, node.n_convs, node.n_children, node.n_leaves, node.saved]
        if edge:
            parent = above.path if above is not None else None
            self.out.append(["edge", self.number, node.slot, *values, None, node.path, parent, node.first, last, node.length, None])
            for k in range(0, len(node.ends), LIST_IDS):
                ids = ",".join(map(str, node.ends[k : k + LIST_IDS]))
                self.out.append(["ends", self.number, k, *[None] * 8, node.path, None, None, None, None, ids])
            return
        ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        row = ["node", self.number, None, *values, ends, *[None] * 6]
        if above.slot is not None:
            row[2] = above.slot
            self.out.append(row)
        else:
            above.waiting.append(row)

    def finish(self) -> None:
        while self.stack:
            self._close(last=True)

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one range of sequences: sorted runs, merged, put on the open path."""
    runs, held, turns = [], [], 0
    for b in batches:
        for conv, key, lengths in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            held.append(Sequence(key, conv, lengths))
            turns += len(lengths) + 1
            if turns >= RUN_TURNS:
                runs.append(sorted_run(held))
                held, turns = [], 0
    runs.append(sorted_run(held))
    path = OpenPath(TaskContext.get().partitionId())
    for s, lcp in LoserTree(runs):
        path.put(s, lcp)
        if len(path.out) >= 5000:
            yield path.batch()
    path.finish()
    if path.out:
        yield path.batch()


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, turns: an array of (digest, length in bytes of the text) a conversation, in the order of its turns.

    Null turns come first; rows of one turn number are ordered by the SHA-256 of their role and text. Null roles and texts
    are empty. Rows without a conv_id are none's.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    symbol = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), symbol.alias("s"), F.octet_length(text).cast("long").alias("n")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(F.substring(t["s"], 1, SYMBOL).alias("s"), t["n"].alias("n"))).alias("turns"))


def rebuilt(own: DataFrame, step: int = 5, modulus: int = 9) -> DataFrame:
    """Conversations whose first turns are replaced by those of the one with the next id below that ``step`` divides.

    As many turns are replaced as the crc32 of the id leaves modulo ``modulus``; where the other is shorter or absent, fewer
    come in their place. A conversation may end up without a turn.
    """
    heads = own.where(F.col("conv_id") % step == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, modulus - 1).alias("__head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    joined = own.withColumn("__base", F.col("conv_id") - F.col("conv_id") % step).join(heads, "__base", "left")
    after = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.when(F.col("__head").isNull(), after).otherwise(F.concat(F.slice("__head", 1, h), after)).alias("turns"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every path's ids, of rows that come path by path and in order: no list is ever held."""
    schema = pa.schema([("path", pa.binary()), ("ends_sha256", pa.string())])
    now, digest, done = None, None, []
    for b in batches:
        for path, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if path != now:
                done += [(now, digest.hexdigest())] if digest is not None else []
                now, digest = path, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], schema=schema)


def prefix_trie(conversations: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """One row a node of the trie of ``conversations`` (conv_id, turns as of ``sequences``): see the columns below.

    conv_id (least member), depth, parent_conv_id (the parent's conv_id), n_convs (members), n_children, n_leaves,
    saved_tokens (bytes of shared turns that its subtree stores once), ends_sha256 (of the ids that end there).

    Spark deals the sequences, by their digests and then ids, to ranges, and each range is an external mergesort: runs
    sorted apart, each sequence with its common prefix with the one before, merged by a loser tree that does not compare
    shared turns again. The merged stream moves a path of open nodes, and a node leaves it finished. Copies of one conversation
    may fill many ranges. Only nodes on the path of a range's first or last sequence can lie in other ranges too: their parts
    are added up, less what neighbours share, and their lists of ids are hashed range by range. A range's size is fixed;
    one conversation is one row, with 24 bytes a turn. An empty table gives an empty result.
    """
    spark = conversations.sparkSession
    flat = conversations.select("conv_id", F.array_join(F.transform("turns", lambda t: F.hex(t["s"])), "").alias("__hex"), F.transform("turns", lambda t: t["n"]).alias("lengths"))
    flat = keep(flat.select("conv_id", F.unhex("__hex").alias("key"), "lengths"), "sequences")
    turns = flat.agg(F.sum(F.size("lengths") + 1)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(turns / range_turns))
    rows = keep(flat.repartitionByRange(ranges, "key", "conv_id").transform(in_batches, _merge, _SCHEMA), "trie")
    edges = rows.where("kind = 'edge'")

    # a range's first path against the last path of the nearest range before it that has rows
    numbers = edges.where("depth = 0").select("range", F.lag("range").over(Window.orderBy("range")).alias("before"))  # one row a range
    lasts = edges.where("is_last").select(F.col("range").alias("before"), "path")
    ends = edges.where("is_last").groupBy(F.col("range").alias("before")).agg(F.max("depth").alias("deepest"))
    firsts = edges.where("is_first").join(numbers.where("before is not null"), "range").select("range", "before", "slot", "depth", "path", "length")
    below = Window.partitionBy("range").orderBy(F.desc("depth"))
    both = firsts.join(lasts, ["before", "path"]).join(ends, "before")
    both = both.withColumn("again", F.sum("length").over(below)).withColumn("to", F.max("depth").over(Window.partitionBy("range")))
    fixes = both.select("range", "slot", F.when(F.col("depth") < F.col("to"), 1).otherwise(0).alias("less_children"), F.when(F.col("to") == F.col("deepest"), 1).otherwise(0).alias("less_leaves"), "again")
    parts = edges.join(fixes, ["range", "slot"], "left").fillna(0, ["less_children", "less_leaves", "again"])
    whole = parts.groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_path").alias("parent_path"), F.sum("n_convs").alias("n_convs"), F.sum(F.col("n_children") - F.col("less_children")).alias("n_children"),
        F.sum(F.col("n_leaves") - F.col("less_leaves")).alias("n_leaves"), F.sum(F.col("saved_tokens") + F.col("again")).alias("saved_tokens"),
    )
    whole = keep(whole, "edges")
    listed = rows.where("kind = 'ends'").select("path", "range", "slot", "ids").repartition("path").sortWithinPartitions("path", "range", "slot")
    hashed = listed.select("path", "ids").transform(in_batches, _streamed, "path binary, ends_sha256 string")
    above = whole.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"))
    shared_nodes = whole.join(hashed, "path", "left").join(above, "parent_path", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    places = edges.select("range", "slot", "path").join(whole.select("path", F.col("conv_id").alias("__above")), "path").select("range", "slot", "__above")
    own = rows.where("kind = 'node'")
    hung = own.where("slot is not null").drop("parent_conv_id").join(places, ["range", "slot"]).withColumnRenamed("__above", "parent_conv_id")
    return own.where("slot is null").select(_NODE).unionByName(hung.select(_NODE)).unionByName(shared_nodes.select(_NODE))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations of a table conv_id, turn, role, text; other columns are ignored.

    See ``sequences`` for nulls and ties, ``rebuilt`` for the new beginnings, ``prefix_trie`` for the result.
    """
    return prefix_trie(rebuilt(keep(sequences(turns), "turns")))
