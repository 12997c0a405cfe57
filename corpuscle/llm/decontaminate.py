"""Benchmark decontamination: MinHash containment search, partitioned by size, with exact verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import shingles
from corpuscle.llm.common import in_batches

#: Items in one block of the index: what is collected and broadcast at once. More items make more blocks.
BLOCK_ITEMS = 20_000
_SIEVE = 22


def sketch_size(n: int, least: float) -> int:
    """Smallest hashes to keep of an item with n shingles.

    Items are partitioned by size, each partition from a power of two to below the next, and a partition has one
    sketch size: one more than the most shingles that any of its items may lack at containment ``least``. By the
    pigeonhole principle every document that holds enough of an item then holds one of its sketch's shingles.
    """
    top = (1 << n.bit_length()) - 1
    return min(n, max(m - ceil(least * m - 1e-9) for m in range((top + 1) // 2, top + 1)) + 1)


@dataclass
class Index:
    """Sketches of a block of test items: sorted hashes with their items, by shingle length."""

    keys: list
    sets: list[set]
    hashes: dict[int, np.ndarray]
    owners: dict[int, np.ndarray]
    sieves: dict[int, np.ndarray]
    least: float
    size: int

    @classmethod
    def build(cls, items: list[tuple[object, str | None]], size: int, least: float) -> Index:
        keys, sets, rows = [], [], defaultdict(list)
        for key, text in items:
            words = shingles.words_of(text)
            if not words:
                continue
            own = min(size, len(words))
            found = np.unique(shingles.shingle_hashes(shingles.word_hashes(text), own))
            rows[own] += [(int(h), len(keys)) for h in found[: sketch_size(len(found), least)]]
            keys.append(key)
            sets.append(shingles.shingle_set(words, size))
        hashes, owners, sieves = {}, {}, {}
        for own, pairs in rows.items():
            pairs.sort()
            hashes[own] = np.array([h for h, _ in pairs], np.uint64)
            owners[own] = np.array([k for _, k in pairs])
            sieves[own] = np.zeros(1 << _SIEVE, bool)
            sieves[own][hashes[own] >> np.uint64(64 - _SIEVE)] = True
        return cls(keys, sets, hashes, owners, sieves, least, size)

    def search(self, text: str | None) -> list[tuple[object, float, int, int]]:
        """Items of which a whole text holds enough: key, containment, shingles held, shingles in all."""
        words, near = shingles.word_hashes(text), set()
        for own, known in self.hashes.items():
            h = shingles.shingle_hashes(words, own)
            h = h[self.sieves[own][h >> np.uint64(64 - _SIEVE)]]
            if len(h):
                lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
                for a, b in {(int(a), int(b)) for a, b in zip(lo, hi, strict=True) if b > a}:
                    near.update(self.owners[own][a:b].tolist())
        if not near:
            return []
        spelled, held, out = shingles.words_of(text), {}, []
        for k in sorted(near):
            item = self.sets[k]
            own = len(next(iter(item)))
            if own not in held:
                held[own] = shingles.shingle_set(spelled, own)
            n = len(item & held[own])
            if n >= self.least * len(item) - 1e-9:
                out.append((self.keys[k], n / len(item), n, len(item)))
        return out


def _blocks(items: DataFrame, size: int, least: float, id_col: str, text_col: str, block_items: int) -> Iterator[Index]:
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    blocks = max(1, ceil(rows.count() / block_items))
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        yield Index.build([(r.i, r.t) for r in own.toLocalIterator()], size, least)


def leaks(docs: DataFrame, items: DataFrame, size: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Pairs of a document and a test item at least ``least`` of whose distinct word shingles the document holds.

    Columns: the two ids, containment, n_shared, n_shingles. Words are runs of letters and digits in any
    case; items of fewer than ``size`` words are one shingle of all their words, items without words match nothing.
    Null texts are empty, repeated rows give repeated pairs, other columns are ignored, empty tables give none.
    Documents are read whole, in place and once for every block of items: no shuffle, no key, no skew. A block's
    index has a proven bound, ``block_items`` short texts.
    """
    kinds = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_col} {items.schema[item_col].dataType.simpleString()}"
    schema = f"{kinds}, containment double, n_shared int, n_shingles int"
    out = None
    for index in _blocks(items, size, least, item_col, item_text_col, block_items):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def of(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in held.value.search(t)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                item = pa.array(columns[1]) if rows else pa.nulls(0, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field(0).type), item, pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32())], [id_col, item_col, "containment", "n_shared", "n_shingles"])

        found = docs.select(id_col, text_col).transform(in_batches, of, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, size: int = 5, least: float = 0.8, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item as ``leaks`` finds them. Filters in place."""
    where = docs.columns.index(text_col)
    for index in _blocks(items, size, least, item_col, item_text_col, block_items):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def of(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not held.value.search(t) for t in b.column(where).to_pylist()], pa.bool_()))

        docs = docs.transform(in_batches, of, docs.schema)
    return docs
