"""Quality scores: similarity-weighted votes of the nearest labelled texts in a latent-semantic space.

A text becomes a row of ``width`` hashed counts: its words, the three-byte patterns of its character classes (letters,
capitals, digits, blanks; punctuation stays itself) and marks for words that repeat the word before. Rows get
log counts, inverse document frequencies and length 1. The truncated singular value decomposition of a bounded
labelled sample gives the latent space. The sample's vectors, bounded by ``sample`` times ``rank`` numbers, go to every task,
which computes all cosines of its texts with them block by block, exactly, and lets the ``neighbours`` nearest vote
with their similarity as weight.

Defined cases: a null or empty text has the zero vector, no neighbour is nearer than another, and it gets the share
of label 1 in the sample; without labelled rows every score is 0.5; null labels and keys are not learned from; of
several labels of a key the maximum counts; ties in similarity go to the row that comes first in the sample (by hash
of the key); repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import arrow, labelled_sample
from wordmill.llm.hashed import PUNCT, runs, words

#: Classes of bytes: small letters, capitals, digits, blanks, parts of other characters; the rest stays itself.
CLASSES = np.arange(256, dtype=np.uint64)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[128:] = 97, 65, 48, 97
CLASSES[[9, 10, 11, 12, 13, 32]] = 32


@dataclass
class Settings:
    sample: int = 4096
    width: int = 2048
    rank: int = 48
    neighbours: int = 25
    rounds: int = 6
    threshold: float = 0.5


@dataclass
class Model:
    settings: Settings
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def counts(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Hashed counts of each row; half of the columns for words, the rest for patterns and repeats."""
    n, half = len(offsets) - 1, width // 2
    hashes, rows, _, _ = words(data, offsets, PUNCT)
    at = [rows * width + (hashes % np.uint64(half)).astype(np.int64)]
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])) if len(hashes) else np.zeros(0, np.int64)
    at.append(rows[again] * width + width - 1)
    if len(data) > 2:
        kinds = CLASSES[data]
        pattern = (kinds[:-2] * np.uint64(65536) + kinds[1:-1] * np.uint64(256) + kinds[2:]) * np.uint64(0x9E3779B97F4A7C15)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        whole = owner[2:] == owner[:-2]
        at.append(owner[2:][whole] * width + half + (pattern[whole] >> np.uint64(40)).astype(np.int64) % (half - 1))
    return np.bincount(np.concatenate(at), minlength=n * width).reshape(n, width).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def latent(rows: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return unit(unit(np.log1p(rows) * idf) @ basis)


def decompose(rows: np.ndarray, rank: int, rounds: int) -> np.ndarray:
    """Right singular vectors of the largest singular values, by subspace iteration from a fixed start."""
    q = np.random.default_rng(7).standard_normal((rows.shape[1], min(rank + 8, rows.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(rows.T @ (rows @ q))
    _, _, turn = np.linalg.svd(rows @ q, full_matrices=False)
    return (q @ turn.T[:, :rank]).astype(np.float32)


def vote(rows: np.ndarray, model: Model, block: int = 512) -> np.ndarray:
    """Scores of latent vectors: exact cosines with every labelled vector, in blocks of rows."""
    k = min(model.settings.neighbours, len(model.labels))
    if k == 0:
        return np.full(len(rows), 0.5)
    out = np.full(len(rows), float(model.labels.mean()))
    for at in range(0, len(rows), block):
        part = rows[at : at + block]
        cosines = part @ model.vectors.T
        near = np.argsort(-cosines, axis=1, kind="stable")[:, :k] if len(model.labels) <= k else _largest(cosines, k)
        weight = np.clip(np.take_along_axis(cosines, near, 1), 0, None)
        total = weight.sum(1)
        some = total > 0
        out[at : at + block][some] = (weight * model.labels[near]).sum(1)[some] / total[some]
    return np.clip(out, 0, 1)


def _largest(cosines: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row; of equal ones at the limit, the first columns."""
    limit = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
    above = cosines > limit
    equal = cosines == limit
    room = k - above.sum(1, keepdims=True)
    taken = above | (equal & (np.cumsum(equal, axis=1) <= room))
    return np.nonzero(taken)[1].reshape(len(cosines), k)


def fit(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", settings: Settings | None = None) -> Model:
    """Latent space and labelled vectors of at most ``settings.sample`` texts; one task holds that bounded sample."""
    s = settings or Settings()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row.tobytes() for _, _, data, offsets in runs(batch["text"], rows=256) for row in counts(data, offsets, s.width)]
            yield pa.record_batch([batch["key"], batch["label"], pa.array(out, pa.binary())], ["key", "label", "row"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(y, np.frombuffer(r, np.float32)) for b in batches for y, r in zip(b["label"].to_pylist(), b["row"].to_pylist(), strict=True)]
        if held:
            rows = np.stack([r for _, r in held])
            idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))).astype(np.float32) + np.float32(0.1)
            basis = decompose(unit(np.log1p(rows) * idf), s.rank, s.rounds)
            parts = (idf, basis, latent(rows, idf, basis), np.array([float(y) for y, _ in held], np.float32))
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in parts], ["idf", "basis", "vectors", "labels"])

    sample = labelled_sample(docs, labels, key, label, s.sample).select(F.col("key").cast("string").alias("key"), "text", "label")
    made = arrow(sample, extract, "key string, label string, row binary")
    ordered = made.repartition(1).sortWithinPartitions(F.md5("key"), "row")
    row = arrow(ordered, train, "idf binary, basis binary, vectors binary, labels binary").first()
    if row is None:
        return Model(s, np.ones(s.width, np.float32), np.zeros((s.width, s.rank), np.float32), np.zeros((0, s.rank), np.float32), np.zeros(0, np.float32))
    idf, basis, vectors, known = (np.frombuffer(row[x], np.float32) for x in ("idf", "basis", "vectors", "labels"))
    return Model(s, idf, basis.reshape(s.width, -1), vectors.reshape(len(known), -1), known)


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """Key, score between 0 and 1, and the decision at the threshold, for every row."""
    s = model.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for at, to, data, offsets in runs(batch["_text"], rows=256):
                scores[at:to] = vote(latent(counts(data, offsets, s.width), model.idf, model.basis), model)
            yield pa.record_batch([batch["_key"], pa.array(scores)], ["_key", "score"])

    plain = docs.select(F.col(key).alias("_key"), F.col("text").alias("_text"))
    scored = arrow(plain, run, f"_key {docs.schema[key].dataType.simpleString()}, score double")
    return scored.select(F.col("_key").alias(key), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))
