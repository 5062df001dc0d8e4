"""Quality by random-indexing word vectors and a small calibrated network (operator 6).

Words are hashed to ``BUCKETS`` buckets.  Each bucket has a fixed sparse ternary index vector; a bucket's word vector is the
sum of the index vectors of all neighbours, up to two words away, over all documents.  Tasks sum their part in a matrix of
fixed size and Spark adds these up by bucket.  A document is pooled to the mean and the spread of its words' vectors, and a
network of two layers, fitted by Adam on at most ``per_class`` labelled rows of each class, gives a logit; a temperature
fitted on rows kept apart turns it into a calibrated probability.

Edge cases: null and empty texts pool to zeros; repeated rows give one row each; ids without label, null labels and values
other than 0 and 1 are not learned from; without labels every score is 0.5; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortweave.llm.common import crc_remainder, each_word_hashes, sample_labels, steps

BITS = 13
BUCKETS = 1 << BITS
WIDTH = 32
WINDOW = 2
HIDDEN = 32
PER_CLASS = 5000


def index_vectors() -> np.ndarray:
    """(BUCKETS + 1, WIDTH) ternary vectors, one in eight places set; the last row is the empty word."""
    rng = np.random.default_rng(6)
    out = rng.choice(np.array([-1, 1], dtype=np.int8), (BUCKETS + 1, WIDTH)) * (rng.random((BUCKETS + 1, WIDTH)) < 0.125)
    out[-1] = 0
    return out.astype(np.float32)


def _buckets(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BITS)).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, from the contexts of every document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, total = index_vectors(), np.zeros((BUCKETS + 1, WIDTH))
        pad = np.full(WINDOW, BUCKETS, dtype=np.int64)
        for x in batches:
            texts = [_buckets(w) for _, w in each_word_hashes(x["text"].tolist(), False)]
            for a, b in steps((len(t) for t in texts), 1 << 17):
                row = np.concatenate([p for t in texts[a:b] for p in (t, pad)])
                vector = index[row]
                near = np.zeros_like(vector)
                for k in range(1, WINDOW + 1):
                    near[k:] += vector[:-k]
                    near[:-k] += vector[k:]
                for d in range(WIDTH):
                    total[:, d] += np.bincount(row, weights=near[:, d], minlength=BUCKETS + 1)
        some = np.flatnonzero(np.abs(total[:-1]).sum(axis=1))
        yield pd.DataFrame({"bucket": some} | {f"v{d}": total[some, d] for d in range(WIDTH)})

    columns = [f"v{d}" for d in range(WIDTH)]
    sums = (docs.select("text").where("text IS NOT NULL").mapInPandas(run, "bucket long, " + ", ".join(f"{c} double" for c in columns))
            .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas())
    out = np.zeros((BUCKETS, WIDTH))
    out[sums["bucket"].to_numpy(np.int64)] = sums[columns].to_numpy()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pool(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """(texts, 2 * WIDTH): mean and spread of the word vectors of every whole text."""
    out = np.zeros((len(texts), 2 * WIDTH))
    for i, words in each_word_hashes(texts, False):
        if len(words):
            found = vectors[_buckets(words)]
            out[i, :WIDTH] = found.mean(axis=0)
            out[i, WIDTH:] = found.std(axis=0)
    return out


@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -700, 700)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, epochs: int = 40, rate: float = 3e-3, seed: int = 6) -> Network:
    """Adam on the weighted log loss; a fifth of the rows is kept apart for the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    apart, own = order[: len(x) // 5], order[len(x) // 5:]
    net = Network(x[own].mean(axis=0), x[own].std(axis=0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)),
                  np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), 0.0)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            z = (x[part] - net.center) / net.scale
            h = np.tanh(z @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -35, 35)))
            g = (p - y[part]) * weight[part] / len(part)
            gh = np.outer(g, params[2]) * (1 - h * h)
            grads, t = [z.T @ gh + 1e-4 * params[0], gh.sum(axis=0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])], t + 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                params[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(apart) >= 20:
        logit = net.logits(x[apart])
        grid = np.exp(np.linspace(-1.5, 2.0, 71))
        loss = [np.average(np.logaddexp(0, np.where(y[apart] == 1, -1, 1) * logit / t), weights=weight[apart]) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, *, column: str = "quality", held_out: Column, per_class: int = PER_CLASS) -> Network | None:
    chosen, counts = sample_labels(labels, column, held_out, per_class)
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"order": x["order"], "label": x["label"], "x": list(pool(x["text"].tolist(), held.value))})

    # At most 2 * per_class rows, of two numbers before and 2 * WIDTH numbers after pooling; an id that repeats teaches once,
    # with its greatest text.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    rows = (found.select(F.xxhash64("doc_id", F.lit(1)).alias("order"), "label", "text")
            .mapInPandas(run, "order long, label int, x array<double>").toPandas().sort_values(["order", "label"]))
    if not len(rows):
        return None
    y = rows["label"].to_numpy(np.float64)
    share = {k: counts.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    return train(np.stack(rows["x"]), y, weight / weight.mean())


def score(docs: DataFrame, vectors: np.ndarray, net: Network | None) -> DataFrame:
    """doc_id and score of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, net = held.value
        for x in batches:
            p = net.probability(pool(x["text"].tolist(), vectors)) if net else np.full(len(x), 0.5)
            yield pd.DataFrame({"doc_id": x["doc_id"].array, "score": p})

    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    held_out = F.coalesce(crc_remainder(3) == 1, F.lit(False))
    vectors = word_vectors(docs)
    out = score(docs, vectors, fit(docs, labels, vectors, held_out=held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
