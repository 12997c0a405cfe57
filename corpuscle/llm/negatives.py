"""Hard negatives by branch and bound in ball trees, one a shard."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.llm.common import in_batches, keep

#: Vectors of a tree, anchors that one task puts to it, vectors of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 4096, 4096, 128
#: Centres that vectors are dealt to, at most: what a task holds to route a query.
MOST_CELLS = 256


def _radius(x: np.ndarray, centre: np.ndarray) -> float:
    return float(np.sqrt(((x - centre) ** 2).sum(1).max())) if len(x) else 0.0


def bounds(queries: np.ndarray, norms: np.ndarray, centre: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """No inner product of a query with a vector of the ball lies outside these two, rounding included."""
    mid, off = queries @ centre, norms * (radius + 1e-9 * (1 + float(np.sqrt((centre**2).sum()))))
    return mid - off, mid + off


class BallTree:
    """A ball tree of integer vectors with their labels; every node is a ball and a range of rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.most = int(abs(self.x).max(initial=0)) * max(1, x.shape[1])
        self.floats = self.x.astype(float) if self.most * self.most < 1 << 53 else None
        self.nodes: list[tuple] = []
        rows = np.arange(len(ids))
        self.compared = 0  # pairs of a query and a row whose product was taken
        self.root = self._grow(rows) if len(rows) else -1

    def _grow(self, rows: np.ndarray) -> int:
        """Splits rows along the line between two far ones, until few or equal ones are left."""
        at = len(self.nodes)
        x = self.x[rows].astype(float)
        centre = x.mean(0)
        only = self.labels[rows[0]] if (self.labels[rows] == self.labels[rows[0]]).all() else None
        self.nodes.append(())
        radius, kids = _radius(x, centre), None
        if len(rows) > LEAF_ROWS and radius > 0:
            a = x[((x - centre) ** 2).sum(1).argmax()]
            b = x[((x - a) ** 2).sum(1).argmax()]
            along = x @ (b - a)
            left = along < along.mean()  # keeps clusters together; where it is lopsided, or nearly, halves instead
            if not len(rows) // 8 <= left.sum() <= len(rows) - len(rows) // 8:
                left = np.zeros(len(rows), bool)
                left[np.argpartition(along, len(rows) // 2)[: len(rows) // 2]] = True
            kids = (self._grow(rows[left]), self._grow(rows[~left]))
        self.nodes[at] = (centre, radius, only, kids, None if kids else np.sort(rows))
        return at

    def products(self, queries: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
        """Integer inner products: in doubles, where these hold them exactly, or in whole numbers."""
        return (queries.astype(float) @ self.floats[rows].T).astype(np.int64) if exact else queries @ self.x[rows].T

    def search(self, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the k rows of largest product within [low, high]: of its own label but not of its id, or of others.

        A node is left out if its ball lies below the window or the k-th product found, or above the window. A bound equal to
        the k-th product keeps the node: the tie may go to a smaller id in it.
        """
        n = len(ids)
        none = -(1 << 62)
        scored, chosen = np.full((n, k), none), np.zeros((n, k), np.int64)
        least = low.copy()
        q, norms = queries.astype(float), np.sqrt((queries.astype(float) ** 2).sum(1))
        high_f = high.astype(float)
        exact = self.floats is not None and int(abs(queries).max(initial=0)) * self.most < 1 << 53

        def leaf(rows: np.ndarray, at: np.ndarray) -> None:
            scores = self.products(queries[at], rows, exact)
            self.compared += scores.size
            fits = (scores >= low[at][:, None]) & (scores <= high[at][:, None]) & (scores >= least[at][:, None])
            fits &= (self.labels[rows][None, :] == labels[at][:, None]) == same
            if same:
                fits &= self.ids[rows][None, :] != ids[at][:, None]
            some = fits.any(1)
            if some.any():
                i = at[some]
                s = np.concatenate([scored[i], np.where(fits[some], scores[some], none)], 1)
                c = np.concatenate([chosen[i], np.broadcast_to(self.ids[rows], (len(i), len(rows)))], 1)
                order = np.lexsort((c, -s), axis=1)[:, :k]
                scored[i], chosen[i] = np.take_along_axis(s, order, 1), np.take_along_axis(c, order, 1)
                least[i] = np.maximum(least[i], scored[i, -1])

        def down(node: int, at: np.ndarray) -> None:
            centre, radius, only, kids, rows = self.nodes[node]
            if only is not None:
                at = at[(labels[at] == only) == same]
            lo, hi = bounds(q[at], norms[at], centre, radius)
            at = at[(hi >= least[at]) & (lo <= high_f[at])]
            if not len(at):
                return
            if kids is None:
                leaf(rows, at)
                return
            toward = q[at] @ (self.nodes[kids[0]][0] - self.nodes[kids[1]][0]) >= 0  # the nearer ball first: it raises the bound
            for first, these in ((0, toward), (1, ~toward)):
                if these.any():
                    down(kids[first], at[these])
                    down(kids[1 - first], at[these])

        if self.root >= 0 and n:
            down(self.root, np.arange(n))
        return [(s[s > none], c[s > none]) for s, c in zip(scored, chosen, strict=True)]


def _sound(vectors: DataFrame, scale: int, dim: int | None) -> tuple[DataFrame, int, int]:
    """id, label, v: rows that take part, with whole-number components; how many; and their length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim")
    first = (sizes if dim is None else sizes.where(F.col("dim") == dim)).first()
    if first is None:
        return rows.where("false").withColumn("v", F.col("v").cast("array<long>")), 0, 1
    rows = rows.where(F.size("v") == first["dim"])
    largest = isqrt((1 << 56) // max(1, first["dim"]))  # so that products, and hundredfold ones, stay whole numbers of 64 bits
    fits = F.forall("v", lambda x: F.abs(x) * scale < float(largest - 1))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.where(fits).select("id", label.alias("label"), F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")), first["n"], first["dim"]


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64).reshape(-1, dim) if len(column) else np.empty((0, dim), np.int64)


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
                   dim: int | None = None, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Vectors are rounded down to whole multiples of 1/``scale``, and products are those of whole numbers, larger first and ties
    to the smaller id. Anchors are the rows whose id ``every`` divides; an anchor's positives are its first rows of its own
    label but for its own id; a positive's negatives are the first rows of other labels with a product between ``low`` and ``high``
    hundredths of the positive's. Ids that 7 divides have the next label of ten.

    Vectors are dealt to the nearest of a few centres, large cells to several shards; a shard is one ball tree. An anchor goes first
    to its nearest cell with rows; the k-th product found there is a floor under which no other cell, and no node of a tree,
    is entered. Negatives are sought within windows that bound products from above as well. Trees meet only the blocks
    of anchors that are routed to them. Every tree, block and result has a fixed size; labels, even one that a third of all rows
    have, are no keys of any shuffle. All is exact.

    Null ids and labels, and vectors null or with a null or non-finite component, take no part; nor do vectors of another length
    than ``dim`` (unset: the commonest), nor components so large that products leave 64 bits. Rows repeated in
    full are candidates each; of anchors with one id the row with the least label and vector counts. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows, n, dim = _sound(vectors, scale, dim)
    count = min(MOST_CELLS, max(1, n // shard_rows))
    sample = rows.orderBy(F.xxhash64(F.lit(3), "id"), "v").limit(count).collect()  # a bounded sample: centres only deal rows out
    pivots = np.array([r.v for r in sample], float).reshape(-1, dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(2).flatten(), float).reshape(b.num_rows, dim)
            d = (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
            cell = d.argmin(1) if len(pivots) else np.zeros(len(x), int)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(1)) if len(pivots) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())], ["id", "label", "v", "cell", "far"])

    placed = keep(rows.transform(in_batches, place, "id long, label long, v array<long>, cell int, far double"), "placed")
    held, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # one row a cell
        held[r.cell], radius[r.cell] = r.n, r.far
    shards = np.maximum(1, -(-held // shard_rows))
    number = F.element_at(F.array(*(F.lit(int(s)) for s in shards)), F.col("cell") + 1) if len(shards) else F.lit(1)

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(part["id"].to_numpy(np.int64), part["label"].to_numpy(np.int64), _matrix(part["v"], dim))
        return pd.DataFrame({"cell": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree, 5)]})

    dealt = placed.withColumn("shard", F.pmod(F.xxhash64("id"), number).cast("int"))
    trees = keep(dealt.groupBy("cell", "shard").applyInPandas(grow, "cell int, shard int, tree binary"), "trees")
    blocks = max(1, ceil(n / every / block_rows))
    best_row = F.min(F.struct("label", "v")).alias("r")
    asked = placed.where(F.col("id") % every == 0).groupBy("id").agg(best_row).select("id", "r.label", "r.v", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(blocks)).cast("int").alias("block"))
    asked = keep(asked, "anchors")

    def routed(queries: DataFrame, home: bool | None) -> DataFrame:
        """Queries (id, label, v, block, tag, low, high) times the shards that may hold what they seek.

        ``home`` True: only their first shard; False: all but that one; None: all.
        """

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = np.asarray(b.column(2).flatten(), float).reshape(b.num_rows, dim)
                ids, lo, hi = np.asarray(b.column(0)), np.asarray(b.column(5)).astype(float), np.asarray(b.column(6)).astype(float)
                norms = np.sqrt((q**2).sum(1))
                mid = np.where(held[None, :] > 0, q @ pivots.T, -np.inf)
                off = norms[:, None] * (radius * (1 + 1e-9) + 1e-6)[None, :]
                first = mid.argmax(1)
                near = (mid + off >= lo[:, None]) & (mid - off <= hi[:, None]) & (held > 0)[None, :]
                if home:
                    near &= np.arange(len(pivots))[None, :] == first[:, None]
                at, cell = np.nonzero(near)
                reps = shards[cell]
                at, cell, place = np.repeat(at, reps), np.repeat(cell, reps), np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                if home is not None:
                    mine = (cell == first[at]) & (place == ids[at] % shards[cell])
                    at, cell, place = (x[mine if home else ~mine] for x in (at, cell, place))
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, pa.array(cell, pa.int32()), pa.array(place, pa.int32())], [*b.schema.names, "cell", "shard"])

        return queries.transform(in_batches, route, "id long, label long, v array<long>, block int, tag long, low long, high long, cell int, shard int")

    def searched(queries: DataFrame, k: int, same: bool) -> DataFrame:
        def put(tree: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(tree) and len(q):
                grown: BallTree = pickle.loads(tree["tree"].iloc[0])
                best = grown.search(q["id"].to_numpy(np.int64), q["label"].to_numpy(np.int64), _matrix(q["v"], dim), q["low"].to_numpy(np.int64), q["high"].to_numpy(np.int64), k, same)
                out = [pd.DataFrame({"id": i, "tag": t, "other": c, "score": s}) for i, t, (s, c) in zip(q["id"], q["tag"], best, strict=True) if len(c)]
            return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("id", "tag", "other", "score")})

        queries = keep(queries, "routed")
        met = trees.join(keep(queries.select("cell", "shard", "block").distinct(), "met"), ["cell", "shard"])  # only trees that some block goes to
        keys = ["cell", "shard", "block"]
        return met.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(put, "id long, tag long, other long, score long")

    def first_of(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("id", "tag").orderBy(F.desc("score"), "other")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    lowest, highest = F.lit(-(1 << 62)), F.lit(1 << 62)
    open_ = asked.select("id", "label", "v", "block", F.lit(0).cast("long").alias("tag"), lowest.alias("low"), highest.alias("high"))
    begun = keep(searched(routed(open_, True), positives, True), "begun")
    floor = begun.groupBy("id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= positives).select("id", "floor")
    rest = open_.join(floor, "id", "left").select("id", "label", "v", "block", "tag", F.coalesce("floor", "low").alias("low"), "high")
    found = first_of(begun.unionByName(searched(routed(rest, False), positives, True)), positives)
    pairs = keep(found.select("id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").cast("long").alias("tag")), "positives")

    # low/100 of the score, rounded up, to high/100, rounded down: whole products between them and no others
    up = F.expr(f"(positive_score * {low} + pmod(-positive_score * {low}, 100)) div 100")
    down = F.expr(f"(positive_score * {high} - pmod(positive_score * {high}, 100)) div 100")
    windows = asked.join(pairs, "id").select("id", "label", "v", "block", "tag", up.alias("low"), down.alias("high")).where("low <= high")
    begun = keep(searched(routed(windows, True), negatives, False), "begun")
    floor = begun.groupBy("id", "tag").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= negatives).select("id", "tag", "floor")
    rest = windows.join(floor, ["id", "tag"], "left").select("id", "label", "v", "block", "tag", F.greatest("low", F.coalesce("floor", "low")).alias("low"), "high")
    mined = first_of(begun.unionByName(searched(routed(rest, False), negatives, False)), negatives)
    return mined.join(pairs, ["id", "tag"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
