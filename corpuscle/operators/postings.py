"""Full-text scores where the documents lie: the terms of a block of queries go to the documents, and no word travels."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpuscle.functions import numeric

#: Terms of queries in one block: what is collected and broadcast at once. More make more blocks, each read over all documents.
BLOCK_TERMS = 100_000
#: Scores, and hits of a term in a query, that are held at once.
CELLS = 1 << 21


@dataclass
class Block:
    """Queries by their terms: sorted terms, and from ``starts`` on the places in ``keys`` of those that ask for each."""

    keys: list
    terms: pa.Array
    starts: np.ndarray
    owners: np.ndarray
    idf: np.ndarray | None = None
    mean: float = 0.0

    @classmethod
    def build(cls, queries: list[tuple[object, list[str]]]) -> Block:
        pairs = sorted((term, n) for n, (_, terms) in enumerate(queries) for term in terms)
        terms = sorted({term for term, _ in pairs})
        place = {term: n for n, term in enumerate(terms)}
        starts = np.zeros(len(terms) + 1, np.int64)
        np.cumsum(np.bincount([place[term] for term, _ in pairs], minlength=len(terms)), out=starts[1:])
        return cls([key for key, _ in queries], pa.array(terms, pa.string()), starts, np.array([n for _, n in pairs], np.int64))

    def weighed(self, counts: dict[int, int]) -> Block:
        """With weights by what ``counted`` found, summed over all documents."""
        docs = counts.get(ROWS, 0)
        df = [counts.get(n, 0) for n in range(len(self.terms))]
        self.idf = np.array([log(1 + (docs - n + 0.5) / (n + 0.5)) for n in df])
        self.mean = counts.get(WORDS, 0) / max(1, counts.get(FULL, 0))
        return self


#: In place of a term's number: documents, those with a text, and their words.
ROWS, FULL, WORDS = -1, -2, -3


def blocks(queries: Iterable[tuple[object, list[str]]]) -> Iterator[Block]:
    held, size = [], 0
    for key, terms in queries:
        held.append((key, terms))
        size += len(terms)
        if size >= BLOCK_TERMS:
            yield Block.build(held)
            held, size = [], 0
    if held:
        yield Block.build(held)


def _hits(texts: pa.Array, block: Block):
    """doc, length, term and count of the terms that a document holds, by document and term; lengths of all texts, null for none.

    A document is a list of texts, nearly always one; texts of one document and length count as one.
    """
    owner = np.repeat(np.arange(len(texts)), texts.value_lengths().to_numpy(zero_copy_only=False))
    lists = texts.flatten().flatten()[0]
    lengths = lists.value_lengths()
    sizes = lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(sizes.max(initial=0)) + 1
    units, of = np.unique(owner * wide + sizes, return_inverse=True)
    term = pc.index_in(lists.flatten(), value_set=block.terms).fill_null(-1).to_numpy(zero_copy_only=False)
    known = term >= 0
    keys, tf = np.unique(np.repeat(of, sizes)[known] * len(block.terms) + term[known], return_counts=True)
    unit, term = np.divmod(keys, len(block.terms))
    doc = units[unit] // wide
    if len(units) > len(texts):
        order = np.lexsort((unit, term, doc))
        unit, term, tf, doc = unit[order], term[order], tf[order], doc[order]
    return doc, units[unit] % wide, term, tf, lengths


def counted(batches: Iterable[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """term and n: in how many documents each term is, and what weights need besides."""
    df, rows, full, words = np.zeros(len(block.terms), np.int64), 0, 0, 0
    for batch in batches:
        _, _, term, _, lengths = _hits(batch.column(1), block)
        df += np.bincount(term, minlength=len(df))
        rows, full, words = rows + len(lengths), full + len(lengths) - lengths.null_count, words + (pc.sum(lengths).as_py() or 0)
    found = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([*found, ROWS, FULL, WORDS], pa.int32()), pa.array([*df[found], rows, full, words], pa.int64())], ["term", "n"])


def _rounded(x: np.ndarray) -> np.ndarray:
    """To nine places, halves up."""
    y = x * 1e9
    low = np.floor(y)
    return (low + (y - low >= 0.5)) / 1e9


def best(batches: Iterable[pa.RecordBatch], block: Block, k: int, key_type: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
    """query, id and score of the k best documents of each query among these, ties by id."""
    width, least, held = len(block.keys), np.full(len(block.keys), -1.0), []
    for batch in batches:
        for part in _scored(batch, block, k, least):
            held.append(part)
        if sum(len(p) for p in held) > 8 * k * width + CELLS // 8:
            held = [_first(held, k, least)]
    if held:
        kept = _first(held, k, least)
        keys = pa.array(block.keys, key_type).take(kept["query"].combine_chunks())
        out = pa.table([keys, kept["id"], kept["score"]], names=names)
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)


def _scored(batch: pa.RecordBatch, block: Block, k: int, least: np.ndarray) -> Iterator[pa.Table]:
    """Rows that may be among the k best; raises ``least``, a score that k documents of a query reach."""
    width, n = len(block.keys), batch.num_rows
    doc, length, term, tf, _ = _hits(batch.column(1), block)
    x = numeric.bm25_weight(block.idf[term], tf, length, block.mean) if len(term) else np.zeros(0)
    asked = np.diff(block.starts)[term]
    upto = np.concatenate(([0], np.cumsum(np.bincount(doc, weights=asked, minlength=n)))).astype(np.int64)
    low = 0
    while low < n:
        high = max(low + 1, min(low + CELLS // width, n, int(np.searchsorted(upto, upto[low] + CELLS, "right")) - 1))
        a, b = np.searchsorted(doc, (low, high))
        times = asked[a:b]
        ends = np.cumsum(times)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(block.starts[term[a:b]] - ends + times, times)
        # summed one after the other, by term
        cells = np.bincount((np.repeat(doc[a:b], times) - low) * width + block.owners[at], weights=np.repeat(x[a:b], times), minlength=(high - low) * width).reshape(high - low, width)
        scores = np.where(cells > 0, _rounded(cells), -1.0)
        if high - low >= k:
            np.maximum(least, np.partition(scores, high - low - k, axis=0)[high - low - k], out=least)
        rows, queries = np.nonzero((scores >= 0) & (scores >= least))
        if len(rows):
            yield pa.table({"query": queries, "score": scores[rows, queries], "id": batch.column(0).take(pa.array(rows + low))})
        low = high


def _first(parts: list[pa.Table], k: int, least: np.ndarray) -> pa.Table:
    """The k first rows of each query."""
    rows = pa.concat_tables(parts)
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("query", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
    query = rows["query"].to_numpy()
    starts = np.flatnonzero(np.diff(query, prepend=-1))
    place = np.arange(len(query)) - np.repeat(starts, np.diff(starts, append=len(query)))
    last = place == k - 1
    least[query[last]] = np.maximum(least[query[last]], rows["score"].to_numpy()[last])
    return rows.filter(pa.array(place < k))
