"""Language of a text: first its language family, then one-versus-one linear support vector machines within it.

A text becomes a row of ``width`` hashed counts of the two- and three-byte runs of its letters (ASCII capitals as
small ones, everything that is not a letter as one blank), as log counts of length 1. A multinomial model over the
counts picks the family. Each pair of languages of that family has a linear machine, trained by subgradient
descent on the hinge loss; the language with most votes wins, equal votes go to the larger sum of margins, then to
the name that comes first.

Defined cases: a null text or one without a letter gets ``und`` and score 0; null or empty languages are not learned
from; without learned rows every text gets ``und``; languages that the family table does not list are families of their own; repeated rows
are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import arrow, labelled_sample
from wordmill.llm.hashed import LOWER, runs

UNKNOWN = "und"
#: Families of closely related languages, a parameter of the operator.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg"),
}

#: Letters stay, small; other ASCII bytes are blanks; bytes of other characters stay.
LETTERS = LOWER.astype(np.uint64)
LETTERS[:97] = np.where((np.arange(97) >= 65) & (np.arange(97) < 91), LETTERS[:97], 32)
LETTERS[123:128] = 32


@dataclass
class Settings:
    sample: int = 6000
    width: int = 4096
    rounds: int = 400
    weight: float = 1e-4
    families: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(FAMILIES))

    def family(self, language: str) -> str:
        return next((name for name, members in self.families.items() if language in members), f"only {language}")


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    families: list[str]
    prior: np.ndarray
    profile: np.ndarray
    pairs: list[tuple[int, int]]
    planes: np.ndarray


def counts(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, width), np.float32)
    letters = LETTERS[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    two = letters[:-1] * np.uint64(256) + letters[1:]
    three = two[:-1] * np.uint64(256) + letters[2:] + np.uint64(1 << 30)
    at = []
    for run, size in ((two, 1), (three, 2)):
        # a run starts at a letter, so blanks and digits alone say nothing
        use = (owner[size:] == owner[: len(owner) - size]) & (letters[: len(run)] != 32)
        place = (run[use] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (width.bit_length() - 1))
        at.append(owner[: len(run)][use] * width + place.astype(np.int64))
    return np.bincount(np.concatenate(at), minlength=n * width).reshape(n, width).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = np.log1p(rows)
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def machine(rows: np.ndarray, sign: np.ndarray, rounds: int, weight: float) -> np.ndarray:
    """Plane (last number: its offset) of a linear support vector machine; both sides weigh the same."""
    x = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    w = mean = np.zeros(x.shape[1], np.float32)
    for step in range(1, rounds + 1):
        inside = np.where(sign * (x @ w) < 1, share * sign, 0).astype(np.float32)
        w = w - (5 / np.sqrt(step)) * (weight * w - inside @ x)
        mean = mean + (w - mean) * (2 / (step + 1))
    return mean.astype(np.float32)


def learn(rows: np.ndarray, names: list[str], s: Settings) -> Model:
    languages = sorted(set(names))
    of = np.array([languages.index(x) for x in names])
    family = [s.family(x) for x in languages]
    families = sorted(set(family))
    kin = np.array([families.index(family[i]) for i in of])
    seen = np.stack([np.log1p(rows[kin == f]).sum(0) + 0.05 for f in range(len(families))])
    profile = np.log(seen / seen.sum(1, keepdims=True)).astype(np.float32)
    prior = np.log(np.array([(kin == f).mean() for f in range(len(families))]))
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if family[a] == family[b]]
    scaled = unit(rows)
    planes = [machine(scaled[(of == a) | (of == b)], np.where(of[(of == a) | (of == b)] == a, 1.0, -1.0).astype(np.float32), s.rounds, s.weight) for a, b in pairs]
    return Model(s, languages, families, prior, profile, pairs, np.stack(planes) if planes else np.zeros((0, s.width + 1), np.float32))


def judge(rows: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language of each row, and the score: share of the family times certainty within it."""
    n, s = len(rows), model.settings
    scaled = unit(rows)
    size = np.log1p(rows)
    evidence = size @ model.profile.T + model.prior
    evidence = evidence - evidence.max(1, keepdims=True)
    # the counts of one text are not independent draws, so the evidence is tempered by its size
    tempered = np.exp(evidence / np.sqrt(np.maximum(size.sum(1, keepdims=True), 1)))
    tempered = tempered / tempered.sum(1, keepdims=True)
    chosen = evidence.argmax(1)
    certain = tempered[np.arange(n), chosen]
    margin = scaled @ model.planes[:, :-1].T + model.planes[:, -1] if len(model.pairs) else np.zeros((n, 0))
    votes, sums = np.zeros((n, len(model.languages))), np.zeros((n, len(model.languages)))
    least = np.full((n, len(model.languages)), np.inf)
    for i, (a, b) in enumerate(model.pairs):
        votes[:, a] += margin[:, i] >= 0
        votes[:, b] += margin[:, i] < 0
        for x, sign in ((a, 1), (b, -1)):
            sums[:, x] += sign * margin[:, i]
            least[:, x] = np.minimum(least[:, x], sign * margin[:, i])
    at = np.array([model.families.index(s.family(x)) for x in model.languages])
    rank = votes + 0.5 * sums / (1 + np.abs(sums))
    best = np.where(at[None, :] == chosen[:, None], rank, -np.inf).argmax(1)
    inner = least[np.arange(n), best]
    inner = np.where(np.isinf(inner), 1.0, 1 / (1 + np.exp(-2 * np.clip(inner, -20, 20))))
    return best, np.clip(certain * inner, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "lang", key: str = "doc_id", settings: Settings | None = None) -> Model | None:
    """Learn from at most ``settings.sample`` texts of known language; one task holds that bounded sample."""
    s = settings or Settings()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row.astype(np.int32).tobytes() for _, _, data, offsets in runs(batch["text"], rows=256) for row in counts(data, offsets, s.width)]
            yield pa.record_batch([batch["key"], batch["label"], pa.array(out, pa.binary())], ["key", "label", "row"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(y, np.frombuffer(r, np.int32).astype(np.float32)) for b in batches for y, r in zip(b["label"].to_pylist(), b["row"].to_pylist(), strict=True)]
        held = [x for x in held if x[1].any()]
        if held:
            m = learn(np.stack([r for _, r in held]), [y for y, _ in held], s)
            yield pa.record_batch([pa.array([m.languages], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in (m.prior, m.profile, m.planes))], ["languages", "prior", "profile", "planes"])

    known = labels.where(F.col(label).isNotNull() & (F.col(label) != ""))
    sample = labelled_sample(docs, known, key, label, s.sample).select(F.col("key").cast("string").alias("key"), "text", "label")
    made = arrow(sample, extract, "key string, label string, row binary")
    ordered = made.repartition(1).sortWithinPartitions(F.md5("key"), "row")
    row = arrow(ordered, train, "languages array<string>, prior binary, profile binary, planes binary").first()
    if row is None:
        return None
    languages = list(row["languages"])
    family = [s.family(x) for x in languages]
    families = sorted(set(family))
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if family[a] == family[b]]
    profile = np.frombuffer(row["profile"], np.float32).reshape(len(families), s.width)
    return Model(s, languages, families, np.frombuffer(row["prior"]), profile, pairs, np.frombuffer(row["planes"], np.float32).reshape(len(pairs), s.width + 1))


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """Key, predicted language and score between 0 and 1, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, _, data, offsets in runs(batch["_text"], rows=256):
                best, certain = judge(counts(data, offsets, model.settings.width), model)
                names += [model.languages[i] for i in best]
                scores.append(certain)
            yield pa.record_batch([batch["_key"], pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0)), batch["_letters"]], ["_key", "lang_pred", "score", "_letters"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    plain = docs.select(F.col(key).alias("_key"), F.col("text").alias("_text"), letters.alias("_letters"))
    if model is None:
        return plain.select(F.col("_key").alias(key), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    judged = arrow(plain, run, f"_key {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, _letters boolean")
    return judged.select(
        F.col("_key").alias(key),
        F.when(F.col("_letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_letters"), F.col("score")).otherwise(0.0).alias("score"),
    )
