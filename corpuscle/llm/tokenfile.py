"""Token-id files: frequency-ranked ids in byte-aligned code with separate control bytes.

A file set is a folder with two Parquet tables that carry opaque blocks, so that any store Spark can write
holds them and Spark's commit protocol guards them:

``vocab``   rank int, id long: every id that occurs, the most frequent first (ties: smaller id).
``blocks``  part int, block int, start long (ids of the part before the block), n_docs, n_tokens, payload binary.

A payload is little-endian: the documents' keys (signed 64-bit), their id counts (unsigned 32-bit), then one
control byte for every four ranks, two bits each, lowest first: the rank's byte count less one; then the ranks'
bytes. Parts are ranges of the key, ascending; blocks ascend within a part, documents within a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import tokens
from corpuscle.llm.common import discard, in_batches, keep, kept_path, shared_path

#: Bytes of ids in one part, about: what a task sorts.
PART_BYTES = 32 << 20
#: Ids after which a block is closed; a block holds whole documents, so a longer document makes a longer block.
BLOCK_TOKENS = 1 << 19
#: Words that a worker holds in one generation here, where nothing else holds its memory (``tokens.MAX_WORDS``): fewer are coded again.
HELD_WORDS = 500_000

_COLUMNS = ["key", "row", "ids", "counts"]
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1  # bytes of the four ranks of a control byte


def pack_ranks(ranks: np.ndarray) -> bytes:
    """Control bytes, then rank bytes."""
    n = len(ranks)
    r = np.zeros(-(-n // 4) * 4, np.uint32)
    r[:n] = ranks
    size = 1 + (r > 0xFF).astype(np.int64) + (r > 0xFFFF) + (r > 0xFFFFFF)
    control = ((size - 1).reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(1).astype(np.uint8)
    size[n:] = 0
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(4):
        has = size > k
        out[at[has] + k] = r[has] >> np.uint32(8 * k)
    return control.tobytes() + out.tobytes()


def unpack_ranks(data: bytes, n: int) -> np.ndarray:
    """Inverse of ``pack_ranks``: byte counts by table lookup on the control bytes, then gathered bytes."""
    raw = np.frombuffer(data, np.uint8)
    m = -(-n // 4)
    size = _LENGTHS[raw[:m]].reshape(-1)[:n]
    body = np.append(raw[m:], np.zeros(3, np.uint8))
    at = np.cumsum(size) - size
    ranks = body[at].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        ranks[has] |= body[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows as they lie: key long, row long (unlike for all rows), ids binary; and one row a task with its counts of ids.

    Ids are little-endian, of two bytes if vocabulary and ``end_id`` allow, else of four; counts are 64-bit, by id.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.coder(tokenizer, HELD_WORDS)
        kind = coder.kind if end_id < 1 << 16 else np.dtype("<u4")
        end = np.array([end_id], kind).tobytes()
        total, row = np.zeros(0, np.int64), TaskContext.get().partitionId() << 33
        for b in batches:
            ids = [coder.encode(t).astype(kind, copy=False).tobytes() + end for t in b.column(1).to_pylist()]
            c = np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(total))
            c[: len(total)] += total
            total = c
            n = len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(row, row + n)), pa.array(ids, pa.binary()), pa.nulls(n, pa.binary())], _COLUMNS)
            row += n
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], _COLUMNS)

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.col(text_col).alias("text"))
    return rows.transform(in_batches, encode, "key long, row long, ids binary, counts binary")


def _frequencies(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs. A task adds up the counts it reads; what returns is no longer than the vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for cell in b.column(0):
                c = np.frombuffer(cell.as_py(), np.int64).copy()
                total, c = (total, c) if len(total) >= len(c) else (c, total)
                total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    found = encoded.where("counts is not null").select("counts").transform(in_batches, add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max((r.id for r in found), default=-1) + 1, np.int64)
    for r in found:
        total[r.id] = r.n
    return total


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1,
                      id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> None:
    """Encodes every whole text, appends ``end_id`` to each and writes the file set described above.

    Null and empty texts are documents of ``end_id`` alone. Null keys are written as the least long and come
    first; rows with one key stay separate documents beside each other, and a key with very many may go on in the next
    part. Other columns are ignored. An empty table gives tables without rows. Texts are tokenised once, where they lie:
    their ids, counted on the way, rest in the shared folder, and only ids are shuffled into the order of keys, into
    as many parts as their bytes call for. A part is numbered and cut into blocks by the task that sorts it.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.default_tokenizer()
    encoded = keep(_encoded(docs, tokenizer, end_id, id_col, text_col), "ids")
    counts = _frequencies(encoded)
    order = [int(i) for i in np.lexsort((np.arange(len(counts)), -counts))[: np.count_nonzero(counts)]]
    spark.createDataFrame([(k, i) for k, i in enumerate(order)], "rank int, id long").coalesce(1).write.parquet(f"{path}/vocab")
    rank = np.zeros(len(counts), np.uint32)
    rank[order] = np.arange(len(order))
    ranks = spark.sparkContext.broadcast(rank)
    kind = tokens.coder(tokenizer).kind if end_id < 1 << 16 else np.dtype("<u4")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(int(counts.sum()) * kind.itemsize / part_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, block, start, keys, texts, held = ranks.value, TaskContext.get().partitionId(), 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(texts), kind)
            head = np.array(keys, "<i8").tobytes() + np.array([len(t) // kind.itemsize for t in texts], "<u4").tobytes()
            cells = [[part], [block], [start], [len(keys)], [len(flat)], [head + pack_ranks(table[flat])]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["part", "block", "start", "n_docs", "n_tokens", "payload"])

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held >= BLOCK_TOKENS:
                    yield close()
                    block, start, keys, texts, held = block + 1, start + held, [], [], 0
                keys.append(key)
                texts.append(t)
                held += len(t) // kind.itemsize
        if keys:
            yield close()

    rows = encoded.where("counts is null").select("key", "row", "ids")
    ranges = rows.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").select("key", "ids")
    ranges.transform(in_batches, pack, "part int, block int, start long, n_docs int, n_tokens long, payload binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    discard(spark, kept_path(encoded)) if order else None


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Reads a file set back: id column, start (ids of all documents before it), n_tokens, ids_crc32 and, if
    asked for, ids. What it collects is bounded: the vocabulary and one total a part."""
    order = np.zeros(1, np.uint32)
    for r in spark.read.parquet(f"{path}/vocab").collect():
        if r["rank"] >= len(order):
            order = np.append(order, np.zeros(r["rank"] + len(order), np.uint32))
        order[r["rank"]] = r["id"]
    blocks = spark.read.schema("part int, block int, start long, n_docs int, n_tokens long, payload binary").parquet(f"{path}/blocks")
    totals = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, so_far = {}, 0
    for part, n in totals:
        before[part] = so_far
        so_far += n
    ids_of = spark.sparkContext.broadcast(order)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ids_of.value
        for b in batches:
            for part, start, docs, n, data in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                keys, sizes = np.frombuffer(data, "<i8", docs), np.frombuffer(data, "<u4", docs, 8 * docs).astype(np.int64)
                ids = table[unpack_ranks(data[12 * docs :], n)].astype("<u4")
                ends = np.cumsum(sizes)
                cut = [ids[e - s : e] for s, e in zip(sizes, ends, strict=True)]
                columns = [pa.array(keys, pa.int64()), pa.array(before[part] + start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64())]
                names = [id_col, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in cut], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks.select("part", "start", "n_docs", "n_tokens", "payload").transform(in_batches, decode, schema)


def token_digest(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes a file set to the shared folder and reads the digest of every document back."""
    path = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
