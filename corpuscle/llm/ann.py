"""Nearest neighbours by inner product with vantage-point trees, one a shard."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.llm.common import in_batches, keep

#: Vectors in one tree and queries that one task puts to it, about: what a task holds in memory.
SHARD_ROWS, QUERY_ROWS = 4096, 4096
#: Pivots at most: what every task holds of the cells.
MOST_CELLS = 256
LEAF_ROWS = 128


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last: equal vectors get equal scores."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


@dataclass
class Best:
    """The k best candidates of each query so far: larger score first, ties to the smaller id."""

    k: int
    scores: list[np.ndarray] = field(default_factory=list)
    ids: list[np.ndarray] = field(default_factory=list)
    least: np.ndarray = field(default_factory=lambda: np.empty(0))
    compared: int = 0  # pairs of a query and a row whose product was taken

    @classmethod
    def of(cls, n: int, k: int, least: np.ndarray | None = None) -> Best:
        return cls(k, [np.empty(0)] * n, [np.empty(0, np.int64)] * n, np.full(n, -np.inf) if least is None else least.astype(float))

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], s[order[-1]])


class VantageTree:
    """A vantage-point tree for inner products.

    Vectors get one more component that brings all to the norm ``reach``; among them, a larger inner product with a
    query is a smaller Euclidean distance to it, and the triangle inequality holds. A node's vantage point splits
    its vectors at the median distance. A far side is left out if ``factor`` times the gap to it exceeds the distance
    of the query's k-th best: factor 1 is exact, a larger one leaves out more.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.reach = ids[order], vectors[order], reach
        lift = np.sqrt(np.maximum(reach**2 - (self.x**2).sum(1), 0))
        self.tall = np.column_stack([self.x, lift])
        self.nodes: list[tuple] = []  # (vantage row, median, inside, outside) or (rows,)
        self.root = self._grow(np.arange(len(ids)))
        del self.tall

    def _grow(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append((rows,))
        if len(rows) > LEAF_ROWS:
            far = self.tall[rows] - self.tall[rows].mean(0)
            vantage = rows[np.argmax((far**2).sum(1))]  # a point at the rim splits best
            d = np.sqrt(((self.tall[rows] - self.tall[vantage]) ** 2).sum(1))
            median = np.partition(d, len(d) // 2)[len(d) // 2]
            inside = d <= median
            if inside.all():  # many at one distance: halve below it, if there is a below
                inside = d < median
                median = d[inside].max() if inside.any() else median
            if 0 < inside.sum() < len(rows):
                self.nodes[at] = (vantage, float(median), self._grow(rows[inside]), self._grow(rows[~inside]))
        return at

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, least: np.ndarray | None = None) -> Best:
        """The k best of every query but rows of its own id, all queries going down the tree together.

        ``least``: of each query a score that k others are known to reach; what is below it is not sought.
        """
        best = Best.of(len(ids), k, least)
        square = (queries**2).sum(1)
        slack = 1e-9 * (1 + self.reach * np.sqrt(square))

        def radius(q: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(square[q] + self.reach**2 - 2 * best.least[q], 0))

        def leaf(rows: np.ndarray, q: np.ndarray) -> None:
            best.compared += len(rows) * len(q)
            near = queries[q] @ self.x[rows].T >= (best.least[q] - slack[q])[:, None]
            near &= self.ids[rows][None, :] != ids[q][:, None]
            a, b = np.nonzero(near)
            if len(a):
                scores = dot(queries[q[a]], self.x[rows[b]])
                cut = np.flatnonzero(np.diff(a)) + 1
                for s, r in zip(np.split(np.arange(len(a)), cut), np.split(rows[b], cut), strict=True):
                    best.add(q[a[s[0]]], scores[s], self.ids[r])

        def down(node: int, q: np.ndarray) -> None:
            if len(self.nodes[node]) == 1:
                return leaf(self.nodes[node][0], q)
            vantage, median, inside, outside = self.nodes[node]
            d2 = square[q] + self.reach**2 - 2 * (queries[q] @ self.x[vantage])  # the query's own lift is 0
            gap = np.sqrt(np.maximum(d2, 0)) - median
            for first, second, these in ((inside, outside, gap <= 0), (outside, inside, gap > 0)):
                if these.any():
                    near, off = q[these], np.abs(gap[these])
                    down(first, near)
                    left = factor * off <= radius(near) + 1e-6 * (1 + self.reach)
                    if left.any():
                        down(second, near[left])
            return None

        if len(ids) and len(self.ids):
            down(self.root, np.arange(len(ids)))
        return best


def _sound(vectors: DataFrame, id_col: str, vec_col: str, dim: int | None) -> tuple[DataFrame, int, float, int]:
    """Vectors that take part, how many, their largest norm and their length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("reach")).orderBy(F.desc("n"), "dim")
    sizes = sizes if dim is None else sizes.where(F.col("dim") == dim)
    first = sizes.first()
    if first is None:
        return rows.where("false").drop("dim"), 0, 1.0, 1
    return rows.where(F.col("dim") == first["dim"]).drop("dim"), first["n"], first["reach"], first["dim"]


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_list()).astype(float).reshape(-1, dim) if len(column) else np.empty((0, dim))


@dataclass
class Cells:
    """The vectors around each of a few pivots: how many, and from which to which distance."""

    pivots: np.ndarray  # with their lift, all of norm ``reach``
    reach: float
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    nearest: np.ndarray = field(default_factory=lambda: np.zeros(0))
    farthest: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of every vector, and the distance to it."""
        tall = np.column_stack([x, np.sqrt(np.maximum(self.reach**2 - (x**2).sum(1), 0))])
        cell = np.argmax(tall @ self.pivots.T, 1)
        return cell, np.sqrt(((tall - self.pivots[cell]) ** 2).sum(1))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No vector of a cell is nearer to a query than this, by the triangle inequality; empty cells are infinitely far."""
        d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + self.reach**2 - 2 * q @ self.pivots[:, :-1].T, 0))
        return np.where(self.count > 0, np.maximum(np.maximum(d - self.farthest, self.nearest - d), 0), np.inf)

    def nearest_cell(self, q: np.ndarray) -> np.ndarray:
        return np.argmax(np.where(self.count > 0, q @ self.pivots[:, :-1].T, -np.inf), 1)


def _placed(rows: DataFrame, n: int, reach: float, dim: int, most_cells: int, cell_rows: int) -> tuple[DataFrame, Cells]:
    """A stored table id, v, cell, and the cells. Pivots are a sample by a hash of the id, of at most ``most_cells``."""
    sample = rows.orderBy(F.xxhash64(F.lit(3), "id"), "v").limit(min(most_cells, max(1, n // cell_rows))).collect()
    x = np.array([r.v for r in sample], float).reshape(-1, dim)
    cells = Cells(np.column_stack([x, np.sqrt(np.maximum(reach**2 - (x**2).sum(1), 0))]), reach)
    if not n:
        return rows.withColumn("cell", F.lit(0)), cells

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, d = cells.place(np.asarray(b.column(1).flatten(), float).reshape(-1, dim)) if b.num_rows else (np.empty(0, int), np.empty(0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d, pa.float64())], ["id", "v", "cell", "d"])

    placed = keep(rows.select("id", "v").transform(in_batches, place, "id long, v array<double>, cell int, d double"), "placed")
    k = len(cells.pivots)
    cells.count, cells.nearest, cells.farthest = np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect():  # one row a cell
        cells.count[r.cell], cells.nearest[r.cell], cells.farthest[r.cell] = r.n, r.lo, r.hi
    return placed.drop("d"), cells


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = 1.0, dim: int | None = None, shard_rows: int = SHARD_ROWS,
            most_cells: int = MOST_CELLS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product for every query.

    Queries are the rows whose id is divisible by ``every`` (of rows with one id, that with the least vector); a query's own
    id is no candidate. Vectors are dealt to the cells of a few pivots, and large cells, such as one that a third of all
    vectors share, to several shards; every row is in the vantage-point tree of one shard. A query first searches one
    tree of its nearest cell. The k-th score found bounds what it still seeks, so that it then goes only to cells that
    the triangle inequality leaves, and in their trees only down such sides. ``factor`` relaxes both: at 1 the result is
    exact; a larger one leaves out more. Vectors without structure, as random ones of many dimensions, leave nothing out.

    Scores are double sums over the original components; ties go to the smaller id. Null ids and vectors null, empty,
    zero or with a null or non-finite component take no part, nor do vectors of another length than ``dim`` (unset:
    the commonest). Repeated rows are candidates each. Other columns are ignored; an empty table gives an empty one. A tree
    and a block of queries have a fixed size; what a shard finds is at most k rows a query, cut to k again before and
    after the shuffle.
    """
    rows, n, reach, dim = _sound(vectors, id_col, vec_col, dim)
    reach *= 1 + 1e-12
    placed, cells = _placed(rows, n, reach, dim, most_cells, max(1, shard_rows // 4))
    shards = np.maximum(1, -(-cells.count // shard_rows))
    number = F.create_map(*(F.lit(int(x)) for c in np.flatnonzero(shards > 1) for x in (c, shards[c]))) if (shards > 1).any() else None
    many = F.lit(1) if number is None else F.coalesce(number[F.col("cell")], F.lit(1))

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = VantageTree(part["id"].to_numpy(np.int64), _matrix(part["v"], dim), reach)
        return pd.DataFrame({"cell": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree, 5)]})

    dealt = placed.withColumn("shard", F.pmod(F.xxhash64("id"), many).cast("int"))
    trees = keep(dealt.groupBy("cell", "shard").applyInPandas(grow, "cell int, shard int, tree binary"), "trees")
    blocks = max(1, ceil(n / every / QUERY_ROWS))
    asked = placed.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(blocks)).cast("int"))
    asked = keep(asked, "asked")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for every shard that a query goes to: without a bound its first, with one the others it may need."""
        names = ["id", "v", "block", "least", "cell", "shard"]
        for b in batches:
            q, ids = np.asarray(b.column(1).flatten(), float).reshape(-1, dim), np.asarray(b.column(0))
            home = cells.nearest_cell(q)
            first = ids % shards[home]
            if b.num_columns == 3:
                at, cell, shard, least = np.arange(len(ids)), home, first, np.full(len(ids), -np.inf)
            else:
                known = np.asarray(b.column(3).fill_null(-np.inf))
                radius = np.sqrt(np.maximum((q**2).sum(1) + reach**2 - 2 * known, 0))
                at, cell = np.nonzero(factor * cells.bounds(q) <= radius[:, None] + 1e-6 * (1 + reach))
                at, cell = np.repeat(at, shards[cell]), np.repeat(cell, shards[cell])
                run = np.flatnonzero(np.diff(np.concatenate([[-1], at * len(shards) + cell])))
                shard = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                other = (cell != home[at]) | (shard != first[at])
                at, cell, shard = at[other], cell[other], shard[other]
                least = known[at]
            taken = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns[:3], pa.array(least, pa.float64()), pa.array(cell, pa.int32()), pa.array(shard, pa.int32())], names)

    def put(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(queries):
            tree = pickle.loads(held["tree"].iloc[0])
            ids = queries["id"].to_numpy(np.int64)
            best = tree.search(ids, _matrix(queries["v"], dim), k, factor, queries["least"].to_numpy(float))
            out = [pd.DataFrame({"query_id": i, "vec_id": c, "score": s}) for i, c, s in zip(ids, best.ids, best.scores, strict=True)]
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})

    def searched(queries: DataFrame) -> DataFrame:
        routed = keep(queries.transform(in_batches, route, "id long, v array<double>, block int, least double, cell int, shard int"), "routed")
        keys = ["cell", "shard", "block"]
        met = trees.join(keep(routed.select(*keys).distinct(), "met"), ["cell", "shard"])  # a tree goes only to blocks with a query for it
        return met.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(put, "query_id long, vec_id long, score double")

    begun = keep(searched(asked.select("id", "v", "block")), "begun")
    seed = begun.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "least")
    found = begun.unionByName(searched(asked.join(seed, "id", "left").select("id", "v", "block", "least")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
