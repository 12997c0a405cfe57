"""Quality and toxicity of documents: hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import shingles
from corpuscle.llm.common import in_batches, keep, smallest_hashes

#: Bound of the fit: labelled documents read of each combination of labels.
SAMPLE_DOCS = 1500
#: Bound of the lexicon: its strongest words.
LEXICON = 5000

_SIGNS = [ord(c) for c in "!?.,|#$%&*@<>{}[]=/_;:-\"'"]


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text: length, shares of kinds of bytes, word and line statistics."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n = len(b)
    c = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    low = b.translate(shingles.FOLD).split()
    raw, lines = b.split(), [x for x in b.split(b"\n") if x.strip()]
    letters = c[65:91].sum() + c[97:123].sum() + c[128:].sum()
    share = lambda x, of: float(x) / max(1, of)
    signs = [min(1.0, 10 * share(c[s], n)) for s in _SIGNS]
    return np.array([
        1.0, np.log1p(n) / 10, np.log1p(len(low)) / 10, share(c[65:91].sum(), letters), share(c[48:58].sum(), n), share(letters, n),
        share(len(set(low)), len(low)), share(n, len(raw)) / 20, share(len(set(lines)), len(lines)), share(max(c[33:48].max(), c[58:65].max(), c[91:97].max(), c[123:127].max()), n),
        share(len(raw) - len(low), len(raw)) if len(raw) > len(low) else 0.0, *signs,
    ])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def forms(word: bytes) -> list[bytes]:
    """What stands for a word in the lexicon: the word itself and its beginnings of 4 to 10 bytes, marked by a blank."""
    return [word, *(b" " + word[:n] for n in range(4, min(11, len(word))))]


@dataclass
class Evidence:
    """What a document says for itself: log-odds of being good and of being toxic."""

    good: np.ndarray | None
    lexicon: dict[bytes, float]
    toxic: np.ndarray | None
    toxic_prior: float

    def __post_init__(self):
        self.starts = {f.lstrip(b" ")[:4] for f in self.lexicon}

    def signs(self, text: str | None) -> np.ndarray:
        """Toxic words of a whole text: 1, their summed and highest log-odds, how many, how dense, log length."""
        words = Counter(shingles.words_of(text))
        near = [w for w in words if w[:4] in self.starts]
        odds = [max(got) for w in near if (got := [self.lexicon[f] for f in forms(w) if f in self.lexicon])]
        n = len(words)
        again = sum(words[w] for w in near) if odds else 0
        return np.array([1.0, sum(odds) / 10, max(odds, default=0.0), np.log1p(len(odds)), np.log1p(again), len(odds) / np.sqrt(n + 1.0), np.log1p(n) / 10])

    def __call__(self, text: str | None) -> tuple[float, float]:
        good = float(np.clip(features(text) @ self.good, -12, 12)) if self.good is not None else 0.0
        toxic = float(np.clip(self.signs(text) @ self.toxic, -12, 12)) if self.toxic is not None else self.toxic_prior
        return good, toxic


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, lexicon: int = LEXICON, id_col: str = "doc_id", text_col: str = "text") -> Evidence:
    """Learns the document evidence from a bounded sample of labelled rows, chosen by a hash of the id.

    Quality: a logistic regression on the text's shape. Toxicity: on three quarters of the sample, the log-odds of
    words and word beginnings between toxic and other documents, each less two standard errors, so that a rare
    one says nothing; on the last quarter, a logistic regression on how many a document has and how dense.
    """
    named = labels.select(F.col(id_col).alias("i"), "quality", "toxic").where("i is not null").groupBy("i").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = smallest_hashes(named, ["quality", "toxic"], "i", sample_docs)
    chosen = chosen.select("i", "quality", "toxic", (F.pmod("place", F.lit(4)) == 0).alias("late"))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i")
    rows = rows.groupBy("i", "quality", "toxic", "late").agg(F.min("t").alias("t")).drop("i")  # an id that repeats is read once
    rows = keep(rows, "labelled")  # at most sample_docs rows a combination of labels

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shape = pa.array([features(t).tolist() for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), shape], ["quality", "shape"])

    kind = labels.schema["quality"].dataType.simpleString()
    rated = rows.where("quality is not null").select("quality", "t").transform(in_batches, read, f"quality {kind}, shape array<double>").toPandas()
    good = logistic(np.stack(rated["shape"].to_list()), (rated["quality"].to_numpy(float) > 0).astype(float)) if rated["quality"].nunique() > 1 else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[bool(toxic)].update({f for w in set(shingles.words_of(text)) for f in forms(w)})
        both = list(seen[0].keys() | seen[1].keys())
        cells = [pa.array(both, pa.binary()), *(pa.array([c[f] for f in both], pa.int64()) for c in (seen[1], seen[0]))]
        yield pa.RecordBatch.from_arrays(cells, ["form", "a", "b"])

    sized = rows.where("toxic is not null").withColumn("toxic", F.col("toxic") > 0)
    early = sized.where(~F.col("late")).groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in early}
    share = labels.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.01
    prior = float(np.log(share / (1 - share))) if share < 1 else 12.0
    if len(n) < 2:
        return Evidence(good, {}, None, prior)
    counts = sized.where(~F.col("late")).select("toxic", "t").transform(in_batches, count, "form binary, a long, b long").groupBy("form").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a > 3")
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (n[True] + 1.0)) - F.log(b / (n[False] + 1.0)) - 2 * F.sqrt(1 / a + 1 / b)
    top = counts.withColumn("odds", odds).where("odds > 0.7").orderBy(F.desc("odds"), "form").limit(lexicon).collect()
    found = Evidence(good, {bytes(r.form): r.odds for r in top}, None, prior)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signs = pa.array([found.signs(t).tolist() for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), signs], ["toxic", "signs"])

    late = sized.where("late").select("toxic", "t").transform(in_batches, sign, "toxic boolean, signs array<double>").toPandas()
    if late["toxic"].nunique() > 1:
        y = late["toxic"].to_numpy(float)
        found.toxic = logistic(np.stack(late["signs"].to_list()), y, ridge=0.1)
        found.toxic[0] += prior - np.log(y.mean() / (1 - y.mean()))  # the sample is balanced, the corpus is not
    return found


def _logit(p):
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def _strength(means: DataFrame, mean: str, n: str, overall: float) -> float:
    """Pseudo-count of a level's prior by the method of moments: how little groups differ beyond chance."""
    spread = means.where(F.col(n) > 1).agg(F.avg(F.pow(F.col(mean) - overall, 2)).alias("v"), F.avg(overall * (1 - overall) / F.col(n)).alias("chance")).first()
    between = max((spread.v or 0.0) - (spread.chance or 0.0), 0.0)
    return float(min(max(overall * (1 - overall) / between - 1, 5.0), 1e5)) if between > 1e-9 else 1e5


def score(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = 0.5,
          id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Posterior quality and toxicity of every row: id column, host, path, quality, toxic, keep.

    A site ``host/path/...`` has two levels: host, and host with first path segment (empty if none). A document speaks for its
    site by its label, if it has one, and else by the classifier's probability. Each level's mean of what its
    documents say is shrunk to the level above, hosts to the whole corpus and paths to their host, by a pseudo-count that
    the spread between groups gives; so a sparse site stays near its parent. A document's posterior log-odds are its
    own evidence and its path's shift from the corpus mean, of which what it says itself is taken out at both levels,
    so that nothing counts twice. ``keep``: quality at least ``threshold`` and toxicity below it.

    Null sites are one host '', null texts count as empty, repeated rows stay, null ids pass, labels of one id are
    averaged, other columns are ignored; without labels of both kinds the evidence is neutral and all is kept; empty tables
    give no rows. Texts are read once by the scoring pass; sites are grouped with partial sums, so that a host with a
    third of all rows is a row a task, and what returns to the driver is one row of moments a level. Rows meet their
    path's few numbers in a join, which Spark may broadcast or split where one path is hot.
    """
    evidence = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_docs, id_col=id_col, text_col=text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [evidence.value(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s[0] for s in said], pa.float64()), pa.array([s[1] for s in said], pa.float64())], [id_col, "site", "g", "t"])

    site = F.regexp_replace(F.coalesce(F.col(site_col).cast("string"), F.lit("")), "^[a-z]+://", "")
    rows = keep(docs.select(F.col(id_col), site.alias("site"), F.col(text_col)).transform(in_batches, of, f"{id_col} {kind}, site string, g double, t double"), "evidence")
    rows = rows.select(id_col, F.substring_index("site", "/", 1).alias("host"), F.coalesce(F.get(F.split("site", "/"), F.lit(1)), F.lit("")).alias("path"), "g", "t")
    share = lambda c: F.avg((F.col(c) > 0).cast("double"))
    named = labels.select(F.col(id_col).alias("__id"), "quality", "toxic").where("__id is not null").groupBy("__id").agg(share("quality").alias("lg"), share("toxic").alias("lt"))
    sure = lambda c: 1 / (1 + F.exp(-F.col(c)))
    said = {f"c{c}": F.coalesce(f"l{c}", sure(c)) for c in "gt"}
    rows = keep(rows.join(named, F.col(id_col) == F.col("__id"), "left").withColumns(said).select(id_col, "host", "path", "g", "t", "cg", "ct"), "said")
    paths = keep(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("cg").alias("sg"), F.sum("ct").alias("st")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("sg").alias("hg"), F.sum("st").alias("ht"))
    all_ = paths.agg(F.sum("n").alias("n"), F.sum("sg").alias("sg"), F.sum("st").alias("st")).first()
    placed, post = rows.join(paths.join(hosts, "host"), ["host", "path"]), []
    for c, name in (("g", "quality"), ("t", "toxic")):
        overall = min(max((all_[f"s{c}"] or 0.0) / max(all_["n"] or 0, 1), 1e-4), 1 - 1e-4)
        k = _strength(hosts.withColumn("m", F.col(f"h{c}") / F.col("hn")), "m", "hn", overall)
        m = _strength(paths.withColumn("m", F.col(f"s{c}") / F.col("n")), "m", "n", overall)
        host = (F.col(f"h{c}") - F.col(f"c{c}") + k * overall) / (F.col("hn") - 1 + k)
        path = (F.col(f"s{c}") - F.col(f"c{c}") + m * host) / (F.col("n") - 1 + m)
        post.append((1 / (1 + F.exp(-(F.col(c) + _logit(path) - _logit(F.lit(overall)))))).alias(name))
    out = placed.select(id_col, "host", "path", *post)
    return out.withColumn("keep", (F.col("quality") >= threshold) & (F.col("toxic") < threshold))
