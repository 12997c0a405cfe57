"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.llm.common import in_batches, keep, smallest_hashes

ORDERS = (2, 3, 4)
SLOT_BITS, PROBES = 20, 3
#: Bounds of the fit: documents read per language, and n-grams per language that enter the filters.
SAMPLE_DOCS, FILTER_GRAMS = 2000, 30_000


@cache
def _letters() -> np.ndarray:
    """Code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of all letter n-grams of a whole text; runs of other characters count as one blank."""
    if not text:
        return np.empty(0, np.uint64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.uint64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first other character after a letter stands for its run
    c = np.concatenate([[0], np.where(letter, c, 0)[kept], [0] * bool(letter[-1])]).astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = c[: len(c) - n + 1].copy()
        for k in range(1, n):
            h = h * np.uint64(0x1F0001) + c[k : len(c) - n + 1 + k]
        h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        out.append(h * np.uint64(0xD6E8FEB86659FD93))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """The places of a hash in a filter: ``PROBES`` separate runs of its bits."""
    return [((h >> np.uint64(k * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(PROBES)]


@dataclass
class Filters:
    """One Bloom filter a language, sliced by bit: word w of a slot holds the slot's bits of languages 64w to 64w+63."""

    languages: list[str]
    words: np.ndarray
    wrong: np.ndarray  # of each language: the share of unseen n-grams that its filter reports all the same

    @classmethod
    def build(cls, languages: list[str], language: np.ndarray, gram: np.ndarray) -> Filters:
        words = np.zeros((max(1, -(-len(languages) // 64)), 1 << SLOT_BITS), np.uint64)
        for k in range(len(languages)):
            for at in _slots(gram[language == k]):
                np.bitwise_or.at(words[k // 64], at, np.uint64(1 << (k % 64)))
        fill = np.array([((words[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        return cls(languages, words, fill**PROBES)

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """N-grams of the text that each language's filter reports."""
        at, out = _slots(grams), []
        for w, table in enumerate(self.words):
            masks = table[at[0]]
            for a in at[1:]:
                masks = masks & table[a]
            n = min(64, len(self.languages) - 64 * w)
            if n <= 8:
                out.append(np.bincount(masks.astype(np.int64), minlength=1 << n) @ (np.arange(1 << n)[:, None] >> np.arange(n) & 1))
            else:
                out.append(np.array([int(((masks >> np.uint64(k)) & np.uint64(1)).sum()) for k in range(n)]))
        return np.concatenate(out)

    def shares(self, grams: np.ndarray) -> np.ndarray:
        """Of each language: the share of the n-grams that its filter knows, less those it reports wrongly."""
        return (self.counts(grams) / len(grams) - self.wrong) / np.maximum(1 - self.wrong, 1e-9)

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = gram_hashes(text)
        if not len(grams) or not self.languages:
            return "und", 0.0
        share = self.shares(grams)
        best = int(np.argmax(share))
        seen = np.maximum(share, 0)
        return self.languages[best], float(seen[best] / seen.sum()) if seen[best] > 0 else 0.0

    def knows(self, text: str | None, least: float) -> bool:
        """Whether some language knows ``least`` of the text's n-grams, or as many as chance allows for so few.

        Texts without letters are not known; if no language could be learnt, every other text is.
        """
        grams = gram_hashes(text)
        if not len(grams) or not self.languages:
            return bool(len(grams))
        return float(self.shares(grams).max()) + 1 / np.sqrt(len(grams)) >= least


def fit(train: DataFrame, sample_docs: int = SAMPLE_DOCS, filter_grams: int = FILTER_GRAMS, contrast: float = 0.25,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Learns the filters from labelled rows.

    Of each language ``sample_docs`` documents are read, chosen by a hash of the id; its filter takes the
    ``filter_grams`` most frequent n-grams whose rate is at least ``contrast`` times the highest rate of any
    language, so that stray foreign passages do not open a filter. Rows with a null language are left out.
    """
    spark = train.sparkSession
    narrow = train.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l")).distinct()
    chosen = smallest_hashes(narrow, ["l"], "i", sample_docs).select("i", "l")
    rows = train.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).join(F.broadcast(chosen.distinct()), ["i", "l"], "left_semi")
    rows = rows.groupBy("i", "l").agg(F.min("t").alias("t"))  # an id that repeats is read once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(gram_hashes(text))
            for lang, parts in held.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], ["l", "g", "n"])

    counts = keep(rows.select("l", "t").transform(in_batches, count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")), "grams")
    totals = {r.l: r.n for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}  # one row a language
    if not totals:
        return Filters([], np.zeros((1, 1 << SLOT_BITS), np.uint64), np.zeros(0))
    sizes = spark.createDataFrame([(k, float(v)) for k, v in totals.items()], "l string, total double")
    rates = counts.join(F.broadcast(sizes), "l").withColumn("rate", F.col("n") / F.col("total"))
    top = F.max("rate").over(Window.partitionBy("g"))
    often = Window.partitionBy("l").orderBy(F.desc("rate"), "g")
    taken = rates.withColumn("top", top).where((F.col("rate") >= contrast * F.col("top")) & (F.col("n") > 1)).withColumn("r", F.row_number().over(often)).where(F.col("r") <= filter_grams)
    found = taken.select("l", "g").toPandas()  # at most filter_grams rows a language
    languages = sorted(totals)
    return Filters.build(languages, found["l"].map({x: k for k, x in enumerate(languages)}).to_numpy(), found["g"].to_numpy().view(np.uint64))


def tagged(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) of every row, from its whole text alone.

    Null texts and texts without letters are ``und`` with score 0. The score is the best language's share of the
    corrected counts. Columns lang_pred and score of the input are replaced. The filters travel as a broadcast of
    8 MB for every 64 languages.
    """
    held = docs.sparkSession.sparkContext.broadcast(filters)
    docs = docs.drop("lang_pred", "score")
    where, names = docs.columns.index(text_col), [*docs.columns, "lang_pred", "score"]
    schema = docs.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [held.value.predict(t) for t in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names)

    return docs.transform(in_batches, of, schema)


def recognised(docs: DataFrame, filters: Filters, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text is in a language that the filters know (``Filters.knows``).

    Null and empty texts and texts without letters go; so do texts in other languages and strings of letters in none. A
    text of n n-grams is given one standard error's double, 1/sqrt(n), so that short ones are not lost by chance.
    Filters in place: columns, even such as lang_pred and score, stay as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(filters)
    where = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([held.value.knows(t, least) for t in b.column(where).to_pylist()], pa.bool_()))

    return docs.transform(in_batches, of, docs.schema)


def identify(docs: DataFrame, held_out: Column, **bounds) -> DataFrame:
    """Fits on the rows that are not held out and predicts all rows: doc_id, held_out, lang_pred, score.

    Null texts count as empty, repeated rows stay, null ids are hashed as the empty text; an empty table, or one
    without a labelled row, gives only ``und``. Columns other than doc_id, text and lang are ignored.
    """
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out)
    filters = fit(rows.where(~F.col("held_out")), **bounds)
    return tagged(rows.select("doc_id", "held_out", "text"), filters).select("doc_id", "held_out", "lang_pred", "score")
