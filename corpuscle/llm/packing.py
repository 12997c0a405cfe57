"""Best-fit packing of token sequences, bettered by swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import tokens
from corpuscle.llm.common import in_batches, keep

#: Pieces that one task packs, about: bounds its memory and leaves well under a bin in a thousand to the edges.
GROUP_PIECES = 8192


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole documents and cuts those longer than ``capacity`` into pieces.

    One row a piece: the id column, piece (from 0), start (the document's ids before it), length, ids_crc32
    (of little-endian unsigned 32-bit ids) and, if asked for, ids. Every document ends with ``end_id``, so a null
    or empty text is one piece of length 1. Null ids pass through, repeated rows give repeated pieces, other
    columns are ignored; an empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.coder(tokenizer)
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(coder.encode(text), np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for column, v in zip(rows, (i, k, at, len(part), zlib.crc32(part.tobytes()), part.tolist() if with_ids else None), strict=True):
                        column.append(v)
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = [id_col, "piece", "start", "length", "ids_crc32", "ids"]
            n = 5 + with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows[:n], kinds[:n], strict=True)], names[:n])

    return docs.select(id_col, text_col).transform(in_batches, cut, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each size, largest first, goes where it leaves the least room.

    Open bins lie in lists by their room; a bit mask of the rooms in use finds the least that suffices.
    """
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = min(sizes[i], capacity)
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room[r - s].append(b)
        mask |= 1 << (r - s)
    return bins


class _Sizes:
    """Items of underfull bins by size, with a bit mask of the sizes present."""

    def __init__(self, capacity: int):
        self.items: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, i: int, s: int) -> None:
        self.items[s].add(i)
        self.mask |= 1 << s

    def take(self, i: int, s: int) -> None:
        self.items[s].discard(i)
        if not self.items[s]:
            self.mask &= ~(1 << s)

    def down(self, most: int, over: int, tries: int) -> Iterator[int]:
        """Sizes present from ``most`` down to ``over`` + 1, a few of them."""
        m = (self.mask & ((1 << (most + 1)) - 1)) >> (over + 1)
        while m and tries:
            top = m.bit_length() - 1
            yield top + over + 1
            m &= ~(1 << top)
            tries -= 1


def improve(bins: list[list[int]], sizes: list[int], capacity: int, passes: int = 12) -> list[list[int]]:
    """Local search: moves, one-for-one and two-for-one exchanges between underfull bins.

    A step takes ``d`` more tokens into a bin than it gives away and is made only if the squared fill of both
    bins together grows, which holds if the receiver ends fuller than the giver began. Squared fill is a whole
    number with a bound, so the search ends; emptied bins go.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    home = {i: k for k, b in enumerate(bins) for i in b}
    bins = [set(b) for b in bins]
    index = _Sizes(capacity)
    for k, b in enumerate(bins):
        if fill[k] < capacity:
            for i in b:
                index.add(i, sizes[i])

    def shift(items: tuple[int, ...], to: int) -> None:
        for i in items:
            a = home[i]
            bins[a].discard(i)
            bins[to].add(i)
            fill[a] -= sizes[i]
            fill[to] += sizes[i]
            home[i] = to

    def pairs_of_emptiest() -> tuple[list[int], list[tuple[int, int]]]:
        low = sorted((k for k in range(len(bins)) if len(bins[k]) > 1 and fill[k] < capacity), key=lambda k: fill[k])[:64]
        found = []
        for k in low:
            own = sorted(bins[k])[:12]
            found += [(sizes[i] + sizes[j], i, j) for x, i in enumerate(own) for j in own[x + 1 :]]
        found.sort()
        return [p[0] for p in found], [p[1:] for p in found]

    def step(b: int, sums: list[int], pairs: list[tuple[int, int]]) -> bool:
        room, own = capacity - fill[b], sorted(bins[b], key=lambda i: (-sizes[i], i))[:16]
        outs: list[tuple[int, ...]] = [(), *((i,) for i in own), *((i, j) for x, i in enumerate(own) for j in own[x + 1 :])]
        best: tuple = (0, None, None)
        for out in outs:
            gone = sum(sizes[i] for i in out)
            for s in index.down(min(capacity, gone + room), gone, 3):
                if s - gone <= best[0]:
                    break
                for n, i in enumerate(index.items[s]):
                    a = home[i]
                    if a != b and fill[b] + s - gone > fill[a]:
                        best = (s - gone, (i,), out)
                        break
                    if n >= 8:
                        break
            if len(out) < 2 and sums:
                k = bisect_right(sums, gone + room) - 1
                for p in range(k, max(-1, k - 6), -1):
                    d, (i, j) = sums[p] - gone, pairs[p]
                    if d <= best[0]:
                        break
                    if home[i] == home[j] != b and fill[b] + d > fill[home[i]]:
                        best = (d, (i, j), out)
                        break
        if not best[0]:
            return False
        _, into, out = best
        a = home[into[0]]
        shift(into, b)
        shift(out, a)
        if fill[b] == capacity:
            for i in bins[b]:
                index.take(i, sizes[i])
        return True

    for _ in range(passes):
        sums, pairs = pairs_of_emptiest()
        changed = False
        for b in sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: (-fill[k], k)):
            for _ in range(8):
                if not 0 < fill[b] < capacity or not step(b, sums, pairs):
                    break
                changed = True
        if not changed:
            break
    return [sorted(b, key=lambda i: (-sizes[i], i)) for b in bins if b]


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES, length_col: str = "length") -> DataFrame:
    """Packs pieces into as few sequences of at most ``capacity`` tokens as local search finds.

    Adds sequence_id (unique, else without meaning) and offset (place in the sequence, gapless from 0). Pieces
    are dealt at random into groups of about ``group_pieces``, each packed by one task; equal pieces spread
    evenly. A null or negative length counts as 0 and takes no room; a piece longer than ``capacity`` gets a
    sequence of its own. Columns sequence_id and offset of the input are replaced. Reads its input twice (a
    count, then the packing): hand it a stored table.
    """
    pieces = pieces.drop("sequence_id", "offset", "__group")
    groups = max(1, ceil(pieces.count() / group_pieces))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    out = pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = [int(x) for x in rows[length_col].fillna(0).clip(lower=0)]
        fits = [i for i, s in enumerate(sizes) if s <= capacity]
        part = [sizes[i] for i in fits]
        bins = [[fits[i] for i in b] for b in improve(best_fit(part, capacity), part, capacity)]
        bins += [[i] for i, s in enumerate(sizes) if s > capacity]
        seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                seq[i], off[i] = (int(key[0]) << 32) | k, at
                at += sizes[i]
        return rows.drop(columns="__group").assign(sequence_id=seq, offset=off)

    return dealt.groupBy("__group").applyInPandas(fit, out)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Encodes, cuts and packs whole documents: ``token_pieces`` stored once, then ``pack``."""
    tokenizer = tokenizer or tokens.default_tokenizer()
    return pack(keep(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
