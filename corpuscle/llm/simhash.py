"""SimHash near-duplicate classes by anchor-point covering."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import shingles
from corpuscle.llm.common import discard, in_batches, keep, kept_path
from corpuscle.llm.components import components

#: What sets the order of shingles, and no result: the share of the hashes' range that is counted exactly, how many of the
#: commonest shingles all tasks know, how many shingles a task counts at once to find these, up to which count one is rare, and
#: how many counters, a power of two, all shingles share in the sketch of their counts, that many in a stored piece of it.
COUNTED = 3 / 16
COMMON_SHINGLES = 1 << 17
COUNTED_AT_ONCE = 1 << 20
RARE = 8
COUNTERS, PIECE = 1 << 19, 1 << 16
#: The first blocks of an anchor, by which fingerprints in several lanes are dealt to groups, and up to how many shingles a text's
#: parities in 128 slots, which could rule out no pair of longer ones, go with them. Neither sets a result.
CELL_BLOCKS = 7
SKETCHED = 256

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in more than half of some 64-bit hashes."""
    columns = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of the word shingles of a whole text, as an unsigned number; no words: 0.

    A-Z are lower-cased, words are runs without ASCII white space, shingles count as often as they occur.
    """
    from xxhash import xxh64_intdigest as h

    w = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    hashes = np.array([h(s, seed) for s in shingles], "<u8")
    return int(majority(hashes))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id column and fp (the fingerprint's bits as a signed long) of every row; null counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, words, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).transform(in_batches, of, f"{id_col} {kind}, fp long")


_LOW = sum(1 << (3 * k) for k in range(21))


def _own(fp: Column) -> tuple[Column, Column]:
    """The anchor of a fingerprint itself, and the blocks whose bits differ among themselves, one bit each."""
    a, b, c = (F.shiftrightunsigned(fp, k).bitwiseAND(F.lit(_LOW)) for k in range(3))
    return a.bitwiseAND(b).bitwiseOR(a.bitwiseAND(c)).bitwiseOR(b.bitwiseAND(c)), a.bitwiseXOR(b).bitwiseOR(a.bitwiseXOR(c))


def _anchors(fp: Column, blocks: int = 21) -> Column:
    """Anchors within reach of a fingerprint, or their first ``blocks``, as an array of longs.

    The covering code is 21 three-bit repetition codes side by side (the 64th bit is free): a point's own anchor
    takes the majority of each block, and every point is within one bit a block of it. One changed bit leaves the
    anchor as it is or flips one block whose bits differ among themselves. So the anchors of all points within one
    bit of ``fp`` are its own and those with one such block flipped: 17 on average, 22 at most. Two fingerprints
    at two bits have a point between them, one bit from each; its anchor is in both arrays.
    """
    own, loose = _own(fp)
    own = own.bitwiseAND(F.lit(sum(1 << (3 * k) for k in range(blocks))))
    bit = [F.lit(1 << (3 * k)) for k in range(blocks)]
    return F.array_compact(F.array(own, *(F.when(loose.bitwiseAND(x) != 0, own.bitwiseXOR(x)) for x in bit)))


def fingerprint_links(fps: DataFrame, fp_col: str = "fp") -> DataFrame:
    """Pairs a < b of distinct fingerprints at 1 or 2 differing bits, each once.

    Every fingerprint is sent to the anchors within reach and compared there with the others sent to it. A
    fingerprint has at most 2080 neighbours within two bits, whatever the number of documents that share it.
    """
    sent = fps.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct().select("fp", F.explode(_anchors(F.col("fp"))).alias("anchor"))
    a, b = (sent.withColumnRenamed("fp", x) for x in "ab")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    return a.join(b, "anchor").where(close).select("a", "b").distinct()


def _reached(fp: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of fingerprints, and the anchors within reach of each (``_anchors``) whose first ``CELL_BLOCKS`` blocks are ``cell``."""
    low, first = np.uint64(_LOW), np.uint64(sum(1 << (3 * k) for k in range(CELL_BLOCKS)))
    a, b, c = (fp >> np.uint64(k) & low for k in range(3))
    own, loose = a & b | a & c | b & c, a ^ b | a ^ c
    here = np.flatnonzero(own & first == np.uint64(cell))
    beside = np.flatnonzero(own & first != np.uint64(cell))  # one of the first blocks is flipped, and no other
    places, anchors = [here, beside], [own[here], own[beside] & ~first | np.uint64(cell)]
    for k in range(CELL_BLOCKS, 21):
        bit = np.uint64(1 << (3 * k))
        free = here[loose[here] & bit != 0]
        places.append(free)
        anchors.append(own[free] ^ bit)
    return np.concatenate(places), np.concatenate(anchors)


def _close_pairs(fp: np.ndarray, of: np.ndarray, cell: int, may: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places a and b of fingerprints in different classes ``of`` at 2 or fewer differing bits that meet at an anchor of a cell, each
    once, and that ``may`` does not rule out.

    A class's fingerprints are not compared among themselves: however many they are, only those of others cost time.
    """
    who, anchor = _reached(fp, cell)
    order = np.lexsort((of[who], anchor))
    who, anchor = who[order], anchor[order]
    new = np.r_[True, anchor[1:] != anchor[:-1]]
    other = new | np.r_[True, of[who[1:]] != of[who[:-1]]]
    ends = lambda starts: np.r_[np.flatnonzero(starts)[1:], len(who)][np.cumsum(starts) - 1]
    i, j, end = np.arange(len(who)), ends(other), ends(new)
    found = []
    while len(i := i[more := j < end]):
        j, end = j[more], end[more]
        a, b = who[i], who[j]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= 2
        a, b = a[near], b[near]
        good = may(a, b)
        found.append(np.unique(np.minimum(a, b)[good] * len(fp) + np.maximum(a, b)[good]))
        j = j + 1
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs // len(fp), pairs % len(fp)


def class_links(fps: DataFrame, least: float) -> DataFrame:
    """Of lane, fp, class, rep, size, sketch_0 and sketch_1 (``_heads``; null: unknown), the reps u and v of all fingerprints of a
    lane at 2 or fewer differing bits in different classes, but for texts whose size or sketch show that their shingles have no
    Jaccard similarity of ``least``.

    The covering is that of ``fingerprint_links``: what is within two bits meets at an anchor. Fingerprints are sent not to
    single anchors but to cells, all anchors with some first blocks: 6 rows each on average, and not 17. A pair that meets in two
    cells or lanes comes twice.
    """
    kind = fps.schema["rep"].dataType.simpleString()

    def close(part: pa.Table) -> pa.Table:
        rep = part["rep"].combine_chunks()
        of = pc.coalesce(part["class"].combine_chunks(), rep).dictionary_encode().indices.to_numpy()
        n, known = part["size"].to_numpy(), part["sketch_0"].is_valid().to_numpy()
        odd = [part[k].fill_null(0).to_numpy() for k in ("sketch_0", "sketch_1")]

        def may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            unlike = sum(np.bitwise_count(x[a].view(np.uint64) ^ x[b].view(np.uint64)).astype(np.int64) for x in odd)
            fit = np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9
            return fit & (~(known[a] & known[b]) | (unlike <= (1 - least) / (1 + least) * (n[a] + n[b]) + 1e-6))

        a, b = _close_pairs(part["fp"].to_numpy().view(np.uint64), of, part["cell"][0].as_py(), may)
        return pa.table({"u": rep.take(pa.array(a)), "v": rep.take(pa.array(b))})

    alone = F.when(F.col("class") != F.col("rep"), F.col("class")).alias("class")
    sent = fps.select("lane", F.explode(_anchors(F.col("fp"), CELL_BLOCKS)).alias("cell"), "fp", alone, "rep", "size", "sketch_0", "sketch_1")
    return sent.groupBy("lane", "cell").applyInArrow(close, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents joined by chains of fingerprints at 2 or fewer differing bits.

    One row a document: id column, fingerprint (16 lower-case hex digits), component_id (the least id of its
    class). Texts are read once; the narrow table of fingerprints is stored. Equal fingerprints meet in an
    aggregate, so a group of copies costs one entry however large. Null and empty texts have fingerprint zero and
    are linked as such; repeated rows stay; null ids get the least non-null id of their class, or null; an empty
    table gives an empty one; other columns are ignored.
    """
    fps = keep(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    first = keep(fps.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")), "classes")
    linked = components(fingerprint_links(first), "a", "b").withColumnRenamed("node", "fp")
    least = linked.join(first, "fp").groupBy("component").agg(F.min("first").alias("least"))
    moved = linked.join(least, "component").select("fp", "least")
    classes = keep(first.join(moved, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id")), "classes")
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    # Fingerprints of more than a thousandth of all rows: fewer than a thousand, whose rows never meet in one task.
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = classes.where(F.col("n") > total / 1000).select("fp", F.col("component_id").alias("hot"))
    rows = fps.join(F.broadcast(hot), "fp", "left")
    met = rows.where("hot is not null").select(id_col, "fp", F.col("hot").alias("component_id"))
    others = rows.where("hot is null").select(id_col, "fp").join(classes.select("fp", "component_id"), "fp")
    return met.unionByName(others).select(id_col, hex_, "component_id")


def lanes_of(text: str | None, lanes: int) -> np.ndarray:
    """Independent fingerprints of the set of a text's words; no words: zeros."""
    h = np.unique(shingles.word_hashes(text))
    if not len(h):
        return np.zeros(lanes, np.uint64)
    out = np.empty(lanes, np.uint64)
    for k in range(lanes):
        x = h * np.uint64(((2 * k + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out[k] = majority(x ^ (x >> np.uint64(29)))
    return out


def similar_documents(docs: DataFrame, least: float = 0.8, words: int = 5, lanes: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents joined by chains of texts whose word shingles have a Jaccard similarity of ``least`` or more.

    One row a document: id column and component_id (the least id of its class). No pair is missed: two texts at the
    threshold share one of the first shingles of their sets, in an order that is the same for all texts (``_heads``).
    Every candidate pair is checked on distinct shingles of ``words`` words, by 48 bits of their hashes; texts with fewer
    words are one shingle.

    Pairs are sought in four rounds, so that a large class costs a few pairs a text and not the square of its size. The
    first takes SimHash of the set of words in several lanes: it ties a text to the least text of its fingerprint in each
    lane, and that one to the least text of the commonest fingerprint within two bits under the same anchor. The second
    ties the texts that share a shingle of their prefixes to one of them, another for each shingle, in two turns. The third
    is the whole covering of SimHash: in each lane all fingerprints within two bits, but only between classes still apart
    (``class_links``); a pair within a class could join nothing. The fourth seeks all pairs that share a prefix shingle early
    enough to overlap as the threshold asks, again between classes still apart.

    Equal texts are one entry from the start. Null counts as empty, empty texts are one
    class, repeated rows stay, a null id gets the least id of its class; an empty table gives an empty one; other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            same = pa.array([hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
            fps = pa.array([lanes_of(t, lanes).view(np.int64).tolist() for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), same, fps], [id_col, "same", "fps"])

    rows = keep(docs.select(id_col, text_col).transform(in_batches, read, f"{id_col} {kind}, same binary, fps array<long>"), "lanes")
    first = keep(rows.where(F.col(id_col).isNotNull()).groupBy("same").agg(F.min(id_col).alias("rep"), F.first("fps").alias("fps")), "texts")
    heads = _heads(docs, first, least, words, id_col, text_col)
    similar = lambda pairs: _similar(docs, heads, keep(pairs, "pairs"), least, words, id_col, text_col)

    members = first.select("rep", F.posexplode("fps").alias("lane", "fp"))
    groups = keep(members.groupBy("lane", "fp").agg(F.min("rep").alias("lo"), F.count("*").alias("n")), "groups")
    ends = members.join(groups.where("n > 1"), ["lane", "fp"])
    pair = lambda df, a, b: df.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))

    at = groups.select("lane", "fp", "lo", "n", _own(F.col("fp"))[0].alias("anchor"))
    best = at.groupBy("lane", "anchor").agg(F.max(F.struct("n", "fp", "lo")).alias("best"))
    tied = at.join(best, ["lane", "anchor"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("best.fp"))) <= 2)
    links = similar(pair(ends, "rep", "lo").unionByName(pair(tied, "lo", F.col("best.lo"))).where("u <> v").distinct())
    named = lambda links: keep(components(links, "u", "v").withColumnsRenamed({"node": "rep", "component": "class"}), "joined")
    more = lambda links, joined: named(links.unionByName(joined.select(F.col("rep").alias("u"), F.col("class").alias("v"))))
    joined = named(links)

    hits = keep(_shared_prefixes(heads), "prefixes")
    of_class = lambda classes: hits.join(classes, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    fit = lambda x, y: F.least(x, y) >= least * F.greatest(x, y) - 1e-9
    for turn in range(2):  # another text for each shingle in the second turn, for those that the first did not reach
        met = of_class(joined)
        star = met.groupBy("shingle").agg(F.min("class").alias("one"), F.max("class").alias("other"), F.min_by(F.struct("rep", "size", "class"), F.xxhash64(F.lit(turn), "rep", "shingle")).alias("star")).where("one <> other").select("shingle", "star")
        tied = met.join(star, "shingle").where((F.col("class") != F.col("star.class")) & fit(F.col("size"), F.col("star.size")))
        late = similar(pair(tied, "rep", F.col("star.rep")).distinct())
        joined = more(late, joined)

    told = heads.select("rep", F.struct("rep", "size", "sketch_0", "sketch_1").alias("one"))
    in_lanes = first.join(told, "rep").join(joined, "rep", "left").select("one", F.coalesce("class", "rep").alias("class"), F.posexplode("fps").alias("lane", "fp"))
    apart = class_links(in_lanes.groupBy("lane", "fp", "class").agg(F.min("one").alias("one")).select("lane", "fp", "class", "one.*"), least)
    joined = more(similar(pair(apart, "u", "v").distinct()), joined)

    met = of_class(joined)
    mixed = met.groupBy("shingle").agg(F.min("class").alias("one"), F.max("class").alias("other")).where("one <> other").select("shingle")
    x, y = (met.join(mixed, "shingle", "left_semi").withColumnsRenamed({c: f"{c}_{k}" for c in ("rep", "size", "place", "class")}) for k in "uv")
    # At the first shingle that two texts share, all that they share stands there or behind, in both: a bound on the overlap.
    ahead = F.least(F.col("size_u") - F.col("place_u"), F.col("size_v") - F.col("place_v"))
    enough = ahead >= least / (1 + least) * (F.col("size_u") + F.col("size_v")) - 1e-6
    apart = x.join(y, "shingle").where((F.col("rep_u") < F.col("rep_v")) & (F.col("class_u") != F.col("class_v")) & fit(F.col("size_u"), F.col("size_v")) & enough)
    last = similar(apart.select(F.col("rep_u").alias("u"), F.col("rep_v").alias("v")).distinct())
    classes = more(last, joined).withColumnRenamed("class", "component")
    for done in (heads, hits, groups):
        if done.columns and not done.isEmpty():
            discard(spark, kept_path(done))
    reps = first.select("same", "rep").join(classes, "rep", "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    return rows.select(id_col, "same").join(reps, "same", "left").select(id_col, "component_id")


def _shingles(text: str | None, words: int) -> np.ndarray:
    """48 bits of the hashes of a text's distinct shingles, ascending."""
    w = shingles.word_hashes(text)
    return np.unique(shingles.shingle_hashes(w, min(words, max(1, len(w)))) >> np.uint64(16))


def parities(hashes: np.ndarray, slots: int = 0) -> np.ndarray:
    """Of each of some slots, if not told at least two for every hash and a power of two in all, whether an odd number of hashes falls there."""
    slots = slots or 64 << max(0, (2 * len(hashes) - 1).bit_length() - 6)
    odd = np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def may_be_similar(x: np.ndarray, y: np.ndarray, n: int, m: int, least: float) -> bool:
    """Whether two sets of n and m hashes with these parities can have a Jaccard similarity of ``least``: never wrongly false.

    Slots of unlike parity hold an element that only one set has, so they are no more than such elements. The finer
    parities are folded to the number of slots of the coarser.
    """
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return min(n, m) >= least * max(n, m) - 1e-9 and int(np.bitwise_count(x ^ y).sum()) <= (1 - least) / (1 + least) * (n + m) + 1e-6


def _counter(hashes: np.ndarray) -> np.ndarray:
    """The counter of each hash: other bits than those that order them."""
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def _counts(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``COMMON_SHINGLES`` commonest shingles of all texts, ascending, their counts, and the sketch: ``COUNTERS`` counts.

    Tasks count some shingles at a time and send on those met twice, so that shingles of one text are never shuffled. Every
    shingle also adds to one counter of the sketch, which a task sends on as a whole, in pieces. Copies met at one time count once.
    The sketch has one size whatever the corpus; what its counters hold beside a shingle is about the shingles a counter.
    """

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "n", "piece", "held"]
        sketch = np.zeros(COUNTERS, np.uint32)

        def out() -> pa.RecordBatch:
            every = np.concatenate(held)
            np.add(sketch, np.bincount(_counter(every), minlength=COUNTERS), out=sketch, casting="unsafe")
            h, n = np.unique(every, return_counts=True)
            some = int((n > 1).sum())
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64)), pa.nulls(some, pa.int32()), pa.nulls(some, pa.binary())], names)

        held, size, met = [], 0, set()
        for b in batches:
            for t in b.column(0).to_pylist():
                if (same := hash(t)) in met:
                    continue
                met.add(same)
                held.append(_shingles(t, words))
                size += len(held[-1])
                if size >= COUNTED_AT_ONCE:
                    yield out()
                    held, size, met = [], 0, set()
        if held:
            yield out()
        for k in range(COUNTERS // PIECE):
            if (part := sketch[k * PIECE : (k + 1) * PIECE]).any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([zlib.compress(np.minimum(part, 65535).astype(np.uint16).tobytes(), 1)])], names)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(packed), np.uint16).astype(np.int64)
                whole[k] = whole[k] + part if k in whole else part
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in whole.values()])], ["piece", "held"])

    found = keep(rows.select("text").transform(in_batches, repeated, "shingle long, n long, piece int, held binary"), "counts")
    counts = found.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n"))
    common = counts.orderBy(F.desc("n"), "shingle").limit(COMMON_SHINGLES).toPandas().sort_values("shingle")
    sketch = np.zeros(COUNTERS, np.int64)
    pieces = found.where("piece is not null").select("piece", "held").repartition("piece").transform(in_batches, added, "piece int, held binary")
    for r in pieces.collect():  # the sketch, of one size
        sketch[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(zlib.decompress(r.held), np.int64)
    if not found.isEmpty():
        discard(rows.sparkSession, kept_path(found))
    return common["shingle"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.int64), np.minimum(sketch, 2**32 - 1).astype(np.uint32)


def _heads(docs: DataFrame, reps: DataFrame, least: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """rep, size (of the text's set of shingles), parity (``parities`` of the set), sketch_0 and sketch_1 (those in 128 slots, of sets of
    at most ``SKETCHED``) and prefix (its first shingles) of each text, stored.

    Two sets with a Jaccard similarity of ``least`` or more share ``least`` of either at the fewest, so that if each
    is put in one order for all sets, the first n - ceil(least * n) + 1 of the n of either meet. Any order serves; this one
    lets few texts meet. Those in the lower ``COUNTED`` of the hashes are counted exactly over all texts, and the
    rare of them go first; then come those not counted, by their counters, the others counted, those whose counters stand
    out from the sketch, and last the commonest of all (``_counts``).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).where("rep is not null")
    order = docs.sparkSession.sparkContext.broadcast(_counts(rows, words))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, n, sketch = order.value
        usual = float(np.median(sketch))
        hot = usual + 8 * np.sqrt(usual + 1) + RARE
        limit = np.uint64(int(COUNTED * (1 << 48)))
        for b in batches:
            sizes, odd, sketches, most, low, high, last = [], [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                h = _shingles(t, words)
                sizes.append(len(h))
                odd.append(parities(h).tobytes())
                sketches.append(parities(h, 128).view(np.int64).tolist() if len(h) <= SKETCHED else [None, None])
                most.append(len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1 if len(h) else 0)
                at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
                often = common[at] == h if len(common) else np.zeros(len(h), bool)
                most_common = h[often][np.argsort(n[at[often]], kind="stable")]
                h = h[~often]
                low.append(h[h < limit].view(np.int64))
                h = h[h >= limit]
                counted = sketch[_counter(h)]
                by = np.argsort(counted, kind="stable")
                h, counted = h[by], counted[by]
                high.append(h[counted <= hot][: most[-1]].view(np.int64))
                last.append(np.concatenate([h[counted > hot], most_common])[: most[-1]].view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (low, high, last)]
            halves = [pa.array([x[k] for x in sketches], pa.int64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(odd, pa.binary()), *halves, pa.array(most, pa.int32()), *lists], ["rep", "size", "parity", "sketch_0", "sketch_1", "most", "low", "high", "last"])

    cuts = rows.transform(in_batches, cut, f"rep {kind}, size int, parity binary, sketch_0 long, sketch_1 long, most int, low array<long>, high array<long>, last array<long>")
    whole = keep(cuts.join(reps.select("rep"), "rep", "left_semi"), "whole")
    entries = whole.select("rep", F.explode("low").alias("shingle"))
    shared = entries.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    counts = entries.join(shared, "shingle").groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("n", "shingle"))).alias("counts"))
    of = lambda keep_: F.array_intersect(F.coalesce(F.filter("counts", keep_)["shingle"], F.array().cast("array<long>")), "low")
    every, rare = of(lambda x: F.lit(True)), of(lambda x: x["n"] <= RARE)
    ordered = F.concat(F.array_except("low", every), rare, "high", F.array_except(every, rare), "last")
    heads = keep(whole.join(counts, "rep", "left").select("rep", "size", "parity", "sketch_0", "sketch_1", F.slice(ordered, F.lit(1), F.col("most")).alias("prefix")), "heads")
    if not whole.isEmpty():
        discard(docs.sparkSession, kept_path(whole))
    return heads


def _shared_prefixes(heads: DataFrame) -> DataFrame:
    """shingle, rep, size, place (in the text's order): every shingle of a text's prefix that is in another's too.

    Counts and joins are by single shingles: no list of texts is gathered, and a join may split a hot shingle.
    """
    entries = heads.select("rep", "size", F.posexplode("prefix").alias("place", "shingle"))
    shared = entries.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")
    return entries.join(shared, "shingle").distinct()


def _similar(docs: DataFrame, heads: DataFrame, pairs: DataFrame, least: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """Of stored pairs u, v of ids, those whose texts' distinct shingles have a Jaccard similarity of ``least`` or more.

    Parities, a small part of a set, rule most other pairs out (``may_be_similar``); the sets themselves, 48 bits a
    shingle, are compared for those left."""
    kind = docs.schema[id_col].dataType.simpleString()

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odd = [[np.frombuffer(x, "<u8") for x in b.column(k).to_pylist()] for k in (2, 3)]
            good = pa.array([may_be_similar(x, y, n, m, least) for x, y, n, m in zip(*odd, b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], ["u", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_shingles(t, words).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["rep", "shingles"])

    def numbers(cell: pa.Scalar) -> np.ndarray:
        raw = np.frombuffer(cell.as_py(), np.uint8).reshape(-1, 6)
        return np.pad(raw, ((0, 0), (0, 2))).view("<u8").reshape(-1)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = numbers(x), numbers(y)
                n = len(np.intersect1d(p, q, assume_unique=True))
                good.append(n >= least * (len(p) + len(q) - n) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good, pa.bool_())), b.column(1).filter(pa.array(good, pa.bool_()))], ["u", "v"])

    of = lambda k: heads.select(F.col("rep").alias(k), F.col("parity").alias(f"parity_{k}"), F.col("size").alias(f"size_{k}"))
    met = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "parity_u", "parity_v", "size_u", "size_v")
    near = keep(met.transform(in_batches, narrow, f"u {kind}, v {kind}").distinct(), "near")
    named = keep(near.select(F.col("u").alias(id_col)).unionByName(near.select(F.col("v").alias(id_col))).distinct(), "named")
    texts = docs.select(id_col, text_col).join(named, id_col, "left_semi").transform(in_batches, cut, f"rep {kind}, shingles binary")
    sets = texts.dropDuplicates(["rep"])
    sized = near.join(sets.withColumnsRenamed({"rep": "u", "shingles": "x"}), "u").join(sets.withColumnsRenamed({"rep": "v", "shingles": "y"}), "v")
    return keep(sized.select("u", "v", "x", "y").transform(in_batches, check, f"u {kind}, v {kind}"), "links")
