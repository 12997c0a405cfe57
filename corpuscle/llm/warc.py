"""WARC archives: written as text by Spark, read back by verifying the chain of record boundaries."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.common import in_batches, shared_path

#: Records in one archive at most; archives roll over, as is usual, so that one task can hold one.
ARCHIVE_RECORDS = 4000
DATE = "2024-01-01T00:00:00Z"

_END = "\r\n\r\n"
#: A whole head, however long: its fields, which may be folded, and the blank line.
_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n|[ \t][^\r\n]*\r\n)*+)\r\n")
_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)")
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a SHA-1: 160 bits are four words of 40 bits, eight letters each."""
    digest = F.sha1(payload)
    letters = []
    for k in range(4):
        word = F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("long")
        for j in range(7, -1, -1):
            letters.append(F.substring(F.lit(_BASE32), F.shiftright(word, 5 * j).bitwiseAND(F.lit(31)).cast("int") + 1, 1))
    return F.concat(*letters)


def write_warc(pages: DataFrame, path: str, least_revisit: int = 0, compression: str = "gzip", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one WARC/1.1 record a row into archives under ``path``, by default compressed.

    The payload is the page in UTF-8; null is empty. Of the rows whose payloads of at least ``least_revisit``
    bytes are equal, those with the smallest id are ``response`` records; the others are ``revisit`` records
    without payload that name it. Smaller payloads are always responses. Null ids count as larger than any other and
    are written as an empty field. Only digests and ids are grouped: a payload shared by a third of all rows is one
    entry of the aggregate, and the join deals its rows out again.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    first = rows.groupBy("digest").agg(F.min("id").alias("first"))
    rows = rows.join(first, "digest")
    again = (F.col("size") >= least_revisit) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        field("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", "")),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))), field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        field("X-Payload-Length", F.col("size").cast("string")),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    record = F.concat(head, F.when(again, "").otherwise(F.col("html")))
    # A record ends in two line breaks; as the writer's line separator they make its text files WARC files.
    rows.select(record.alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", ARCHIVE_RECORDS).option("compression", compression).text(path)


def candidates(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Every place that reads as a record, in a payload or not: offset, successor's offset, fields, payload.

    A successor past the end of the archive makes a place no candidate; so does a head without a length.
    """
    for m in _HEAD.finditer(content):
        body = m.end() - 4
        fields = {k.decode("latin-1").lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(m[1])}
        length = fields.get("content-length", "")
        if not length.isdigit():
            continue
        start, stop = body + 4, body + 4 + int(length)
        if content[stop : stop + 4] == b"\r\n\r\n":
            yield m.start(), stop + 4, fields, content[start:stop]


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping.

    ``jump`` leads 2**k records on; in each round the records reached so far reach those 2**k further, and the
    jumps double. A chain of n records takes log2(n) rounds.
    """
    order = np.argsort(offset, kind="stable")
    at = offset[order]
    end = len(at)
    place = np.searchsorted(at, successor[order])
    known = (place < end) & (at[np.minimum(place, end - 1)] == successor[order]) if end else np.zeros(0, bool)
    jump = np.append(np.where(known, place, end), end)
    reached = np.zeros(end + 1, bool)
    reached[:1] = end > 0 and at[0] == 0
    while True:
        grown = reached.copy()
        grown[jump[reached]] = True
        if (grown == reached).all() and (jump == end).all():
            break
        reached, jump = grown, jump[jump]
    out = np.zeros(end, bool)
    out[order] = reached[:end]
    return out


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Reads every archive under ``path``: one row a record that the chain of boundaries reaches.

    Compressed archives are unpacked, so offsets are those of the records themselves. Columns:
    archive, record_offset, page_id, url, record_type, refers_to, payload_bytes, payload_digest (of the payload found;
    a revisit's from its fields) and, if asked for, payload. Tasks emit each candidate with its successor's offset;
    an archive's candidates, a few numbers each, then meet in one group whose size its archive bounds. Heads that
    stand inside payloads are never reached and go. An archive that does not begin with a record gives no rows; a chain
    that does not end where its archive ends is an error.
    """
    kinds = {"archive": pa.string(), "record_offset": pa.int64(), "successor": pa.int64(), "size": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()} | ({"payload": pa.binary()} if with_payload else {})
    schema = "archive string, record_offset long, successor long, size long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload

    def key(text: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(m[1]) if m else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                raw = content.as_py()
                whole = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                for at, successor, f, payload in candidates(whole):
                    again = f.get("warc-type") == "revisit"
                    length = int(f.get("x-payload-length", "0")) if again else len(payload)
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") if again else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((archive, at, successor, len(whole), key(f.get("warc-record-id")), f.get("warc-target-uri"), f.get("warc-type"), key(f.get("warc-refers-to")), length, digest, payload)[: len(kinds)])
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        chain = rows[reachable(rows["record_offset"].to_numpy(np.int64), rows["successor"].to_numpy(np.int64))]
        if len(chain) and chain["successor"].max() != chain["size"].iloc[0]:
            raise ValueError(f"{chain['archive'].iloc[0]}: records end at {chain['successor'].max()} of {chain['size'].iloc[0]} bytes")
        return chain

    # small archives: a handful to a task
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")
    return files.transform(in_batches, scan, schema).groupBy("archive").applyInPandas(verify, schema).drop("successor", "size")


def archive_digest(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Writes archives to the shared folder, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Repeated rows are repeated records, an empty table gives no archive and no rows, other columns are ignored.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path, least_revisit)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
