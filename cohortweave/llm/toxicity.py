"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 4).

Features of a text are the hashed distinct words, their stems (first 4 to 7 bytes: inflected forms meet there), pairs of
neighbours and pairs with one or two words between them (ASCII case folded, ASCII punctuation dropped).  The learner keeps a rate for each coordinate and an L1 penalty, so most weights are
exactly zero; only the others are broadcast (at most ``BUCKETS`` of them).

The fit reads at most ``per_class`` labelled rows of each class, their whole texts, in hash order, one after the other
through an iterator: the driver holds one partition of features at a time.  The intercept is then moved to the class
proportions of all labelled rows that are not held out.

Edge cases: null and empty texts have no features and get the intercept's score; repeated rows give one row each; labels
of unknown ids, null labels and values other than 0 and 1 are not learned from; without labels every score is 0; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortweave.llm.common import crc_remainder, each_word_hashes, mix, sample_labels, staged

BUCKETS = 1 << 18
PER_CLASS = 3000
SKIPS = (1, 2, 3)
STEMS = (4, 5, 6, 7)


def features(words: np.ndarray) -> np.ndarray:
    """Distinct buckets of a text's words, stems, neighbours and skip-grams; ``words`` has a row for each stem length."""
    full = words[0]
    parts = [words.ravel(), *(mix(full[:-k] * np.uint64(2 * k + 1) + full[k:]) for k in SKIPS if len(full) > k)]
    return np.unique((np.concatenate(parts) >> np.uint64(64 - 18)).astype(np.int32))


def _features(texts: list[str | None]) -> Iterator[np.ndarray]:
    for _, words in each_word_hashes(texts, True, False, STEMS):
        yield features(words)


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal updates for 0/1 features."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    z: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


@dataclass
class Model:
    index: np.ndarray
    value: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.float64)
        out[self.index] = self.value
        return out


def train(rows: Iterable[tuple[int, np.ndarray]], passes: int = 1) -> Ftrl:
    learner = Ftrl()
    rows = rows if passes == 1 else list(rows)
    for _ in range(passes):
        for label, at in rows:
            learner.learn(np.append(at, BUCKETS), label)
    return learner


def fit(docs: DataFrame, labels: DataFrame, *, column: str = "toxic", held_out: Column, per_class: int = PER_CLASS, passes: int = 3) -> Model:
    chosen, counts = sample_labels(labels, column, held_out, per_class)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [at.tobytes() for at in _features(x["text"].tolist())]
            yield pd.DataFrame({"order": x["order"], "label": x["label"], "at": rows})

    # At most 2 * per_class rows of two numbers; an id that repeats teaches once, with its greatest text.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    found = found.groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    rows = found.select(F.xxhash64("doc_id", F.lit(1)).alias("order"), "label", "text").mapInPandas(run, "order long, label int, at binary")
    rows = staged(rows.orderBy("order"))
    learner, seen = Ftrl(), {0: 0, 1: 0}
    for k in range(passes):
        for r in rows.orderBy("order").toLocalIterator():
            learner.learn(np.append(np.frombuffer(r["at"], dtype=np.int32), BUCKETS), r["label"])
            seen[r["label"]] += k == 0
    every = np.arange(BUCKETS + 1)
    w = learner.weights(every)
    index = np.flatnonzero(w[:-1])
    bias = float(w[-1])
    if all(seen.values()):
        bias += math.log(counts[1] / counts[0]) - math.log(seen[1] / seen[0])
    elif not any(seen.values()):
        bias = -math.inf
    return Model(index.astype(np.int32), w[index], bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, bias = held.value.dense(), held.value.bias
        for x in batches:
            total = np.fromiter((weight[at].sum() for at in _features(x["text"].tolist())), dtype=np.float64, count=len(x))
            yield pd.DataFrame({"doc_id": x["doc_id"].array, "score": 1 / (1 + np.exp(-np.clip(total + bias, -700, 700)))})

    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    held_out = F.coalesce(crc_remainder(5) == 0, F.lit(False))
    out = score(docs, fit(docs, labels, held_out=held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
