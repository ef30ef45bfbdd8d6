"""Quality scores by Bradley-Terry pairwise ranking.

Every text becomes a vector of measures (shares of byte classes and marks, word and line shapes, repetition).  From labelled
rows, preference pairs (a document of label 1 over one of label 0) are drawn, and the weights are fitted by logistic loss on the
difference of the pair's vectors.  A document's strength is its weighted sum; the threshold is the quantile of the strengths that
leaves the share of label 0 below it.  The score is the logistic of the strength above the threshold.

Training takes a bounded sample: at most ``SAMPLE_ROWS`` labelled rows of each label by a hash of doc_id, and ``PAIRS`` pairs of
them.  Scoring is one narrow pass without a shuffle over whole texts.

Defined results.  Null text is scored as the empty text.  With only one label in the sample there are no pairs: every score is that
label (1.0 or 0.0), and 0.5 where there is no label at all.  A document with contradicting labels counts with each of them.  Repeated rows each
give a row; extra columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.common import bounded_batches, hash_sample, sliced

SAMPLE_ROWS = 4_000
PAIRS = 60_000
RIDGE = 1e-3

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _classes() -> np.ndarray:
    """One row a byte class: lower, upper, digit, space, newline, other white space and controls, non-ASCII, then each mark."""
    rows = [np.zeros(256) for _ in range(7)]
    rows[0][97:123] = rows[1][65:91] = rows[2][48:58] = rows[3][32] = rows[4][10] = rows[6][128:] = 1
    rows[5][:32], rows[5][10], rows[5][127] = 1, 0, 1
    marks = np.zeros((len(_MARKS), 256))
    marks[np.arange(len(_MARKS)), list(_MARKS)] = 1
    return np.vstack([*rows, marks])


_CLASSES = _classes()
DIMENSIONS = 2 * len(_CLASSES) + 16


def features(text: str | None) -> np.ndarray:
    """The measures of one whole text; each is between 0 and about 1, and all are 0 for the empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(DIMENSIONS)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = _CLASSES @ counts / len(raw)
    k = len(share)
    out[:k], out[k : 2 * k] = share, np.sqrt(share)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = len(words), max(1, len(lines))
    if n:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        different = len(set(words))
        bare = sum(not w.isalnum() for w in words)
        out[2 * k :] = [
            min(1.0, np.log1p(n) / 10), different / n, different / n**0.8 / 4, lengths.mean() / 20, lengths.std() / 20, (lengths <= 1).mean(), (lengths >= 15).mean(), min(1.0, lengths.max() / 100),
            bare / n, sum(w.isupper() for w in words) / n, len(set(lines)) / m, min(1.0, n / m / 100), sum(x[-1] in ".!?\"'" for x in lines) / m, sum(len(x) < 30 for x in lines) / m,
            min(1.0, m / 50), sum(x[:1].isupper() for x in lines) / m,
        ]
    return out


class Model:
    """Weights over the standardised measures, and the threshold."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, pairs: int = PAIRS):
        self.constant = None
        good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        if not len(good) or not len(bad):
            self.constant = 0.5 if not len(labels) else float(len(good) > 0)
            return
        self.mean, spread = vectors.mean(0), vectors.std(0)
        self.scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0)
        z = np.clip((vectors - self.mean) * self.scale, -6, 6)
        rng = np.random.default_rng(7)
        n = min(pairs, len(good) * len(bad))
        diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
        w = np.zeros(z.shape[1])
        for _ in range(25):  # Newton's method on the ridge-penalised pairwise logistic loss
            p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
            grad = -diff.T @ p / n + RIDGE * w
            hess = (diff * (p * (1 - p))[:, None]).T @ diff / n + RIDGE * np.eye(len(w))
            move = np.linalg.solve(hess, grad)
            w -= move / max(1.0, np.abs(move).max() / 2)
            if np.abs(move).max() < 1e-6:
                break
        self.weights = w
        strength = z @ w
        self.threshold = float(np.quantile(strength, len(bad) / len(labels)))

    def score(self, vectors: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(vectors), self.constant)
        z = np.clip((vectors - self.mean) * self.scale, -6, 6)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights - self.threshold, -500, 500)))


def _rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in sliced(batches, 0):
            v = np.array([features(t.as_py()) for t in b.column(0)]).reshape(b.num_rows, DIMENSIONS)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.list_(pa.float64())), b.column(1), b.column(2)], names=["v", "quality", "doc_id"])

    return docs.select("text", F.col("quality").cast("int").alias("quality"), "doc_id").mapInArrow(run, "v array<double>, quality int, doc_id long")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, quality): at most so many rows of each label."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    picked = [(k, g) for g, k, _ in hash_sample(known, "quality", "doc_id", rows)]
    # At most 2 * rows pairs of numbers: bounded, so they may be broadcast.
    chosen = docs.sparkSession.createDataFrame(picked, "doc_id long, quality int")
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.length("text")).alias("text"))
    got = sorted(_rows(sample).collect(), key=lambda r: (r.doc_id, r.quality))  # so that the same pairs are drawn each time
    return Model(np.array([r.v for r in got]).reshape(len(got), DIMENSIONS), np.array([r.quality for r in got]))


def held_out():
    """The rows that are not learned from: CRC-32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string").cast("binary")) % 3 == 1


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns in keep, score and predicted of every row."""

    def run(batches):
        for b in sliced(batches, 1):
            v = np.array([features(t.as_py()) for t in b.column(1)]).reshape(b.num_rows, DIMENSIONS)
            s = model.score(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(i) for i in range(2, b.num_columns)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[b.schema.names[0], *b.schema.names[2:], "score", "predicted"])

    frame = bounded_batches(docs).select("doc_id", "text", *(keep or []))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != "text")
    return frame.mapInArrow(run, f"{fields}, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model, ["held_out"])
