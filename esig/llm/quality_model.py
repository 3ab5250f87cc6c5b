"""Quality classifier: random-indexing word vectors pooled per document, and a small calibrated network.

Every hashed word has a sparse random index vector. Its context vector is the sum of the index vectors of the words
within two places of it, over the whole corpus. A document is the mean context vector and the mean index vector of
its words, and the mean index vector of its word boundaries (two bytes before and after each gap, or the fact that the words on both sides are equal),
with the lengths of these means, the share of equal neighbours and the log of the word count. A network of two layers learns the labels from these; a temperature, chosen on rows the network has not seen, calibrates its
probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import text_chunks, with_field

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 2, 2
#: The network is fitted on at most so many labelled rows; word vectors cover the whole corpus.
FIT_ROWS = 10_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 30, 256, 3e-3, 1e-4
FOLDS, CALIBRATION_FOLD = 5, 4
REJECT_BELOW = 0.3
WIDTH = 3 * DIM + 5
_RNG = np.random.default_rng(0xD0C)
_AT = _RNG.integers(0, DIM, (2 * BUCKETS, NONZERO))
_SIGN = _RNG.choice([-1, 1], (2 * BUCKETS, NONZERO))
_INDEX = np.zeros((2 * BUCKETS, DIM), np.float32)
np.add.at(_INDEX, (np.arange(2 * BUCKETS)[:, None], _AT), _SIGN)


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and boundary buckets of all words of the texts in a row, and the document each belongs to."""
    split = [t.encode().split() if t else [] for t in texts]
    n = np.array([len(ws) for ws in split])
    words = [w for ws in split for w in ws]
    doc = np.repeat(np.arange(len(texts)), n)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), doc
    word = (pd.util.hash_array(np.array(words, dtype=object), categorize=False) % np.uint64(BUCKETS)).astype(np.int64)
    data = np.frombuffer(b"  " + b" ".join(words) + b"  ", np.uint8).astype(np.uint64)
    gap = 2 + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    follows = np.append(doc[1:] == doc[:-1], False).astype(np.uint64)
    code = data[gap - 2] | data[gap - 1] << np.uint64(8) | (data[np.minimum(gap + 1, len(data) - 1)] << np.uint64(16) | data[np.minimum(gap + 2, len(data) - 1)] << np.uint64(24)) * follows
    edge = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64)
    # A gap between two equal words is a term of its own.
    return word, BUCKETS + np.where(np.append(word[1:] == word[:-1], False) & (follows > 0), 0, np.maximum(edge, 1)), doc


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) context vectors of unit length over all texts; zero where a bucket has no context.

    Tasks add up integers bucket by bucket, and Spark adds up tasks, so the result doesn't depend on partitions. Only
    this table of fixed size comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIM)
        for b in text_chunks(batches, 0):
            word, _, doc = _terms(b.column(0).to_pylist())
            for d in range(1, WINDOW + 1):
                near = np.flatnonzero(doc[d:] == doc[:-d])
                for a, c in ((word[near], word[near + d]), (word[near + d], word[near])):
                    for z in range(NONZERO):
                        total += np.bincount(a * DIM + _AT[c, z], weights=_SIGN[c, z], minlength=BUCKETS * DIM)
        table = total.reshape(BUCKETS, DIM).astype(np.int64)
        some = np.flatnonzero(table.any(axis=1))
        for i in range(0, len(some), 4096):
            part = some[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(table[part, j]) for j in range(DIM)]], names=["b", *[f"v{j}" for j in range(DIM)]])

    schema = "b bigint, " + ", ".join(f"v{j} bigint" for j in range(DIM))
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema).groupBy("b").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(DIM)])
    out = np.zeros((BUCKETS, DIM))
    rows = sums.toPandas()
    if len(rows):
        out[rows["b"].to_numpy()] = rows[[f"v{j}" for j in range(DIM)]].to_numpy(dtype=np.float64)
    return (out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """(texts, WIDTH) document vectors; zero for a text without words."""
    word, edge, doc = _terms(texts)
    n = np.bincount(doc, minlength=len(texts))
    out = np.zeros((len(texts), WIDTH))
    some = np.flatnonzero(n)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        for k, rows in enumerate((vectors[word], _INDEX[word], _INDEX[edge])):
            mean = np.add.reduceat(rows, starts, axis=0, dtype=np.float64) / n[some, None]
            out[some, k * DIM : (k + 1) * DIM] = mean
            out[some, 3 * DIM + k] = np.sqrt((mean * mean).sum(axis=1))
        out[some, -2] = np.add.reduceat(edge == BUCKETS, starts, dtype=np.float64) / n[some]
        out[some, -1] = np.log1p(n[some])
    return out


class Network:
    """Two layers with tanh, trained by Adam on standardised inputs; ``temperature`` divides the logit."""

    def __init__(self, width: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 1 / math.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.mean, self.scale, self.temperature, self.constant = np.zeros(width), np.ones(width), 1.0, None

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -20, 20) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z, rng = np.clip((x - self.mean) / self.scale, -20, 20), np.random.default_rng(11)
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for i in range(0, len(z), BATCH):
                a, t = z[order[i : i + BATCH]], y[order[i : i + BATCH]]
                h = np.tanh(a @ self.p[0] + self.p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3][0], -30, 30))) - t) / len(a)
                back = np.outer(g, self.p[2]) * (1 - h * h)
                grads = [a.T @ back + DECAY * self.p[0], back.sum(axis=0), h.T @ g + DECAY * self.p[2], np.array([g.sum()])]
                step += 1
                for k, d in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Network:
        """The temperature of the least log loss on rows kept from training."""
        z = self.logit(x)
        grid = np.geomspace(0.5, 8, 49)
        loss = [np.mean(np.logaddexp(0, np.where(y > 0, -z, z) / t)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fold(doc_id: str = "doc_id") -> Column:
    """CRC-32 of the id as text, modulo 5; fold 0 is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(0)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, fit_rows: int = FIT_ROWS) -> Network:
    """A network fitted on at most ``fit_rows`` labelled documents, taken in order of a hash of their ids. Of rows that share
    an id one text counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y IN (0, 1)")
    known = known.withColumn("f", fold()).where("f <> 0").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(fit_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", "y", "f").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # an id counts once, however often it comes
    data = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 3):
            x = pooled(b.column(3).to_pylist(), data.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "f", "x"])

    got = rows.mapInArrow(run, "doc_id bigint, y int, f int, x binary").toPandas().sort_values(["doc_id", "y", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, WIDTH).astype(np.float64)
    y, part = got["y"].to_numpy(dtype=np.float64), got["f"].to_numpy() == CALIBRATION_FOLD
    net = Network(WIDTH)
    if len(set(y[~part])) < 2:
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    net.fit(x[~part], y[~part])
    return net.calibrate(x[part], y[part]) if part.any() else net


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with held_out, score and predicted; columns of these names are replaced.

    Score is the calibrated probability of label 1, rounded to 9 places; predicted is 1 from ``REJECT_BELOW`` up. Only
    texts enter a score; equal texts score alike. Null and empty texts have the zero vector. Without labelled rows
    of both labels the score is their mean, or 0.5 if there are none. Null ids are held out.
    """
    kept = docs.drop("held_out", "score", "predicted")
    vectors = word_vectors(docs)
    data = docs.sparkSession.sparkContext.broadcast((vectors, fit(docs, labels, vectors, fit_rows)))
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = data.value
        for b in text_chunks(batches, at):
            p = np.round(net.probability(pooled(b.column(at).to_pylist(), vectors)), 9)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "score"])

    rows = kept.mapInArrow(run, with_field(kept.schema, "score", "double"))
    return rows.withColumn("held_out", fold() == 0).withColumn("predicted", F.when(F.col("score") >= REJECT_BELOW, 1).otherwise(0))
