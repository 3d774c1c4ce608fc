"""Classifiers on bag-of-words features: a linear one with as many coefficients as there are words, and small networks of Spark ML."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.operators.metrics import class_scores, confusion, mcc_of
from wordmill.operators.scale import join_by_token, new_path, settle, task_count

#: The intercept is a feature that every row has once.
INTERCEPT = -1
L2 = 1e-4
#: Features, counted in every row, of one block of rows.
BLOCK_CELLS = 1_000_000
_BLOCK = "block int, idx binary, label binary, size binary, at binary, width int, x binary"


def feature_vectors(features: DataFrame, rows: DataFrame, key: str, label: str, size: int) -> DataFrame:
    """Sparse vectors of the rows, settled; a row without features gets the zero vector.

    The vectors are written as the plain columns that make up a sparse vector and read back as vectors, so no row passes through Python.
    """
    lists = features.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("cnt").cast("double").alias("cnt")))).alias("f")
    )
    filled = rows.select(key, F.col(label).cast("double").alias("label")).join(lists, key, "left")
    sparse = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(size).alias("size"),
        F.coalesce("f.idx", F.array().cast("array<int>")).alias("indices"),
        F.coalesce("f.cnt", F.array().cast("array<double>")).alias("values"),
    )
    plain = filled.select(key, "label", sparse.alias("features"))
    path = new_path(plain.sparkSession, "vectors")
    plain.write.parquet(path)
    schema = T.StructType([*plain.schema.fields[:2], T.StructField("features", VectorUDT())])
    return plain.sparkSession.read.schema(schema).parquet(path)


def report(guesses: DataFrame, name: str) -> DataFrame:
    """Macro F1 and Matthews correlation of gold and predicted labels of one evaluation set."""
    scores = settle(class_scores(confusion(guesses).withColumn("set", F.lit(name)), ["set"]), "scores")
    return scores.groupBy("set").agg(F.avg("f1").alias("macro_f1")).join(mcc_of(scores, ["set"]), "set")


def scored(model, data: DataFrame, name: str) -> DataFrame:
    """Scores of a fitted model on one evaluation set."""
    return report(model.transform(data).select(F.col("label").alias("gold"), F.col("prediction").alias("pred")), name)


def examples(features: DataFrame, rows: DataFrame, key: str, label: str) -> DataFrame:
    """Settled ``(row, label, f)`` for the linear model: all features of a row with their counts, the intercept among them.

    Labels are 0, 1, ...; rows without a label or a key take no part, keys are distinct. A row without features has the intercept alone.
    """
    counted = F.struct(F.col("idx").cast("bigint").alias("idx"), F.col("cnt").cast("double").alias("x"))
    lists = features.groupBy(key).agg(F.collect_list(counted).alias("f"))
    known = rows.select(key, F.col(label).cast("int").alias("label")).where(F.col(key).isNotNull() & F.col("label").isNotNull())
    one = F.array(F.struct(F.lit(INTERCEPT).cast("bigint").alias("idx"), F.lit(1.0).alias("x")))
    every = F.when(F.col("f").isNull(), one).otherwise(F.concat(one, "f"))
    return settle(known.join(lists, key, "left").select(F.col(key).alias("row"), "label", every.alias("f")), "examples")


def _cells(data: DataFrame, *carried: str) -> DataFrame:
    return data.select(*carried, F.explode("f").alias("c")).select(*carried, "c.idx", "c.x")


def margins(data: DataFrame, coefs: DataFrame, name: str, classes: int) -> DataFrame:
    """``(row, label, m)``: the score of every class for each row, by the coefficients ``name``0, ``name``1, ...; unknown features count nothing."""
    table = coefs.select("idx", "freq", *[f"{name}{k}" for k in range(classes)])
    hits = join_by_token(_cells(data, "row", "label"), table, "left", "idx")
    sums = [F.coalesce(F.sum(F.col("x") * F.col(f"{name}{k}")), F.lit(0.0)) for k in range(classes)]
    return hits.groupBy("row", "label").agg(F.array(*sums).alias("m"))


def class_count(data: DataFrame) -> int:
    return (data.agg(F.max("label")).first()[0] or 0) + 1


def linear_steps(data: DataFrame, steps: int, l2: float = L2) -> Iterator[DataFrame]:
    """Coefficients of the multinomial linear model after each of ``steps`` passes over settled examples.

    The loss is the mean cross entropy plus half of ``l2`` times the squared coefficients. Coefficients are a settled table with one row for each
    feature (w0, w1, ... by class), never on the driver. The rows stay where they are, in blocks, each packed into one row of numbers with its features
    numbered: a pass sends every block the coefficients of its own
    features, once each, adds up the margins of its rows and the gradient of its features there, and only these sums are shuffled back. Each feature
    has a rate of its own, half of the sum of its counts times the
    sizes of their rows: by convexity of the square that bounds the curvature of the loss, so no step size is to be tuned and the loss
    falls at every plain step; the steps are accelerated by momentum (v0, v1, ... is the point the next gradient is taken at).
    """
    classes, n = class_count(data), max(1, data.count())
    cells = data.agg(F.sum(F.size("f"))).first()[0] or 0
    parts = max(task_count(data.sparkSession), cells // (2 * BLOCK_CELLS))
    blocks = data.select("label", "f", F.pmod(F.xxhash64("row"), F.lit(2 * parts)).cast("int").alias("block"))
    rows = blocks.repartition(parts, "block").groupBy("block").applyInArrow(_packed_block, _BLOCK)
    rows = rows.repartition(parts, "block").sortWithinPartitions("block").persist(StorageLevel.DISK_ONLY)
    met = rows.mapInArrow(_block_rates, "idx bigint, block int, n bigint, pull double")
    rates = met.groupBy("idx").agg(
        F.sum("n").alias("freq"), (F.sum("pull") / (2 * n) + l2).alias("rate"), F.collect_list("block").alias("blocks")
    )
    zero = [F.lit(0.0).alias(f"{c}{k}") for c in "wv" for k in range(classes)]
    told = "idx bigint, " + ", ".join(f"g{k} double" for k in range(classes))
    try:
        coefs, pace = settle(rates.select("*", *zero), "coefs"), 1.0
        for _ in range(steps):
            point = coefs.select(F.explode("blocks").alias("block"), "idx", *[f"v{k}" for k in range(classes)])
            slopes = rows.groupBy("block").cogroup(point.groupBy("block")).applyInArrow(_block_slopes(classes), told)
            slopes = slopes.groupBy("idx").agg(*[(F.sum(f"g{k}") / n).alias(f"g{k}") for k in range(classes)])
            following = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
            momentum, pace = (pace - 1) / following, following
            moved = [(F.col(f"v{k}") - (F.col(f"g{k}") + l2 * F.col(f"v{k}")) / F.col("rate")).alias(f"n{k}") for k in range(classes)]
            kept = ["idx", "freq", "rate", "blocks"]
            after = coefs.join(slopes, "idx").select(*kept, *[f"w{k}" for k in range(classes)], *moved)
            point = [(F.col(f"n{k}") + momentum * (F.col(f"n{k}") - F.col(f"w{k}"))).alias(f"v{k}") for k in range(classes)]
            coefs = settle(after.select(*kept, *[F.col(f"n{k}").alias(f"w{k}") for k in range(classes)], *point), "coefs")
            yield coefs.drop("blocks")
    finally:
        rows.unpersist()


def _packed_block(rows: pa.Table) -> pa.Table:
    """The rows of one block as one: its features in order, and for all cells the place of the feature and the count, in a byte if all fit."""
    lists = rows["f"].combine_chunks()
    flat = lists.flatten()
    idx, at = np.unique(flat.field("idx").to_numpy(), return_inverse=True)
    x = flat.field("x").to_numpy()
    if x.min(initial=0) >= 0 and x.max(initial=0) < 256 and (x == np.floor(x)).all():
        x = x.astype(np.uint8)
    told = {"idx": idx, "label": rows["label"].to_numpy().astype(np.int32), "size": pc.list_value_length(lists).to_numpy().astype(np.int32), "at": at.astype(np.int32)}
    packed = {c: pa.array([v.tobytes()], pa.binary()) for c, v in told.items()}
    return pa.table({"block": rows["block"][:1], **packed, "width": pa.array([x.itemsize], pa.int32()), "x": pa.array([x.tobytes()], pa.binary())})


class _Block:
    def __init__(self, packed: dict) -> None:
        get = lambda c, kind: np.frombuffer(packed[c], kind)
        self.idx, self.label, self.at = get("idx", np.int64), get("label", np.int32), get("at", np.int32)
        self.x = get("x", np.uint8 if packed["width"] == 1 else np.float64)
        self.row = np.repeat(np.arange(len(self.label)), get("size", np.int32))


def _block_rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every feature of a block its cells and the sum of their counts times the sizes of their rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            packed = batch.slice(i, 1).to_pylist()[0]
            block = _Block(packed)
            x = np.abs(block.x.astype(float))
            size = np.bincount(block.row, x, len(block.label))
            n, pull = np.bincount(block.at, minlength=len(block.idx)), np.bincount(block.at, x * size[block.row], len(block.idx))
            columns = [pa.array(block.idx), pa.array(np.full(len(n), packed["block"], np.int32)), pa.array(n.astype(np.int64)), pa.array(pull.astype(float))]
            yield pa.RecordBatch.from_arrays(columns, ["idx", "block", "n", "pull"])


def _block_slopes(classes: int):
    """Gradient of the cross entropy, summed over the rows of one block, for the features that come in it."""

    def run(rows: pa.Table, point: pa.Table) -> pa.Table:
        block = _Block(rows.to_pylist()[0])
        order = np.argsort(point["idx"].to_numpy())
        m = np.stack([np.bincount(block.row, block.x * point[f"v{k}"].to_numpy()[order][block.at], len(block.label)) for k in range(classes)])
        e = np.exp(m - m.max(axis=0))
        missed = e / e.sum(axis=0) - (block.label == np.arange(classes)[:, None])
        slopes = {f"g{k}": np.bincount(block.at, block.x * missed[k][block.row], len(block.idx)) for k in range(classes)}
        return pa.table({"idx": block.idx, **slopes})

    return run


def linear_guesses(data: DataFrame, coefs: DataFrame) -> DataFrame:
    """``(row, gold, pred)`` of settled examples; of equal scores the smaller class."""
    classes = sum(c.startswith("w") for c in coefs.columns)
    best = F.array_position("m", F.array_max("m")) - 1
    return margins(data, coefs, "w", classes).select("row", F.col("label").alias("gold"), best.cast("int").alias("pred"))


def bow_classifier(
    train: DataFrame, evals: dict[str, DataFrame], max_iter: tuple[int, ...] = (5, 20)
) -> DataFrame:
    """Linear classifier, scored on every evaluation set after each training length; the best is kept.

    ``train`` and the evaluation sets are ``examples``. The longer training goes on from the shorter one.
    """
    rounds = []
    for step, coefs in enumerate(linear_steps(train, max(max_iter)), 1):
        if step in max_iter:
            rounds += [report(linear_guesses(data, coefs), name) for name, data in evals.items()]
    table = rounds[0]
    for part in rounds[1:]:
        table = table.unionByName(part)
    return table.groupBy("set").agg(F.max("macro_f1").alias("best_macro_f1"), F.max("mcc").alias("best_mcc"))


def network(train: DataFrame, layers: list[int], steps: int = 20, seed: int = 42):
    """Fitted feed-forward network with the given layer sizes."""
    return MultilayerPerceptronClassifier(layers=layers, maxIter=steps, seed=seed).fit(train)


def mlp(train: DataFrame, evals: dict[str, DataFrame], layers: list[int], steps: int = 20, seed: int = 42) -> DataFrame:
    """Small feed-forward classifier with the given layer sizes, scored on every evaluation set."""
    model = network(train, layers, steps, seed)
    parts = [scored(model, data, name) for name, data in evals.items()]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table
