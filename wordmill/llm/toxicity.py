"""Toxicity scores: logistic regression trained by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are its words, pairs of neighbouring words and pairs with one word between them (in small letters,
punctuation apart), hashed into ``2**bits`` marks that say whether the text holds the feature. Features of fewer than
``min_docs`` learned texts stay out. Per-coordinate rates let rare features learn fast, and the L1 term keeps most
weights at zero, so the model that goes to the executors is a short list of (feature, weight).

Defined cases: a null or empty text has no features and gets the score of the intercept; a null label or key is not
learned from; several labels of one key count as their maximum; repeated rows are scored one by one; without any
labelled row every score is the prior 0.0; columns of the input other than the key and the text are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.llm.common import arrow, labelled_sample
from wordmill.llm.hashed import PUNCT, distinct, grams, runs, words

#: Distances of the words that make up a feature.
SHAPES = ((0,), (0, 1), (0, 2))
THRESHOLD = 0.3


@dataclass
class Settings:
    """``sample`` bounds the labelled texts that are learned from, ``bits`` the number of weights."""

    sample: int = 8192
    bits: int = 20
    min_docs: int = 5
    epochs: int = 5
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    threshold: float = THRESHOLD


@dataclass
class Model:
    settings: Settings
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = -np.inf

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << self.settings.bits, np.float32)
        table[self.features] = self.weights
        return table


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and row of every occurrence."""
    hashes, rows, _, _ = words(data, offsets, PUNCT)
    found = [grams(hashes, rows, steps, seed)[:2] for seed, steps in enumerate(SHAPES)]
    shift = np.uint64(64 - bits)
    return np.concatenate([(g >> shift).astype(np.int64) for g, _ in found]), np.concatenate([r for _, r in found])


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """State of the per-coordinate updates; the last coordinate is the intercept, which has no L1 term."""

    def __init__(self, settings: Settings) -> None:
        self.s = settings
        self.z = np.zeros((1 << settings.bits) + 1)
        self.n = np.zeros((1 << settings.bits) + 1)
        self.l1 = np.full((1 << settings.bits) + 1, settings.l1)
        self.l1[-1] = 0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        rate = (self.s.beta + np.sqrt(self.n[at])) / self.s.alpha + self.s.l2
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = sigmoid(float(w.sum())) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + gradient**2


def fit(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", settings: Settings | None = None) -> Model:
    """Learn from at most ``settings.sample`` labelled texts; features are made where the texts are, the
    sequential updates run over that bounded sample in one task."""
    s = settings or Settings()
    bits, beyond = s.bits, 1 << s.bits

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for at, to, data, offsets in runs(batch["text"]):
                found, rows = distinct(*features(data, offsets, bits))
                ends = np.searchsorted(rows, np.arange(to - at + 1))
                out += [found[ends[i] : ends[i + 1]].astype(np.int32).tobytes() for i in range(to - at)]
            yield pa.record_batch([batch["key"], batch["label"], pa.array(out, pa.binary())], ["key", "label", "ids"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(int(y), np.frombuffer(ids, np.int32)) for b in batches for y, ids in zip(b["label"].to_pylist(), b["ids"].to_pylist(), strict=True)]
        if not rows:
            return
        held = np.zeros(beyond, np.int32)
        for _, ids in rows:
            held[ids] += 1
        rows = [(y, np.append(ids[held[ids] >= s.min_docs], beyond)) for y, ids in rows]
        state = Ftrl(s)
        for _ in range(s.epochs):
            for y, ids in rows:
                state.learn(ids, y)
        w = state.weights(np.arange(beyond + 1))
        at = np.flatnonzero(w[:-1])
        yield pa.record_batch([pa.array([at.astype(np.int32).tobytes()]), pa.array([w[at].tobytes()]), pa.array([float(w[-1])])], ["ids", "weights", "intercept"])

    sample = labelled_sample(docs, labels, key, label, s.sample)
    made = arrow(sample.select(F.col("key").cast("string").alias("key"), F.lower("text").alias("text"), "label"), extract, "key string, label string, ids binary")
    ordered = made.repartition(1).sortWithinPartitions(F.md5("key"), "ids")
    row = arrow(ordered, train, "ids binary, weights binary, intercept double").first()
    if row is None:
        return Model(s)
    return Model(s, np.frombuffer(row["ids"], np.int32).astype(np.int64), np.frombuffer(row["weights"]), row["intercept"])


def mark(docs: DataFrame, model: Model, to: str = "score", text: str = "text") -> DataFrame:
    """The rows with their score between 0 and 1."""
    if to.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the rows have a column {to} already")
    names, width = [*docs.columns, to], len(docs.columns)
    ids, weights, intercept, settings = model.features, model.weights, model.intercept, model.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = Model(settings, ids, weights, intercept).dense()
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for a, b, data, offsets in runs(batch.column(width)):
                found, rows = features(data, offsets, settings.bits)
                used = dense[found] != 0
                found, rows = distinct(found[used], rows[used])
                scores[a:b] = np.bincount(rows, dense[found], b - a)
            scores = sigmoid(scores + intercept) if np.isfinite(intercept) else scores * 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(scores)], names)

    small = docs.select(*docs.columns, F.lower(text).alias(f"{to}_text"))
    return arrow(small, run, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """Key, score between 0 and 1, and the decision at the threshold, for every row."""
    scored = mark(docs.select(F.col(key), F.col("text")), model)
    return scored.select(key, "score", (F.col("score") >= model.settings.threshold).cast("int").alias("predicted"))
