"""Association between frequency buckets and labels, embedding proximity, probe and drop reports."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.functions.arrays import unnest
from wordmill.functions.hashing import hash_key
from wordmill.operators.features import bucket_histogram, ordered_pairs
from wordmill.operators.scale import join_by_token, settle, take_first
from wordmill.operators.vocab import bucketize, field_tokens, label_prior, token_buckets


def labelled_counts(df: DataFrame, label: str, text: str) -> DataFrame:
    """Occurrences of every token under every label: the one corpus pass of the first-order statistics."""
    rows = unnest(df, [F.col(label).alias("label")], field_tokens(text))
    return settle(rows.groupBy("label", "token").agg(F.count("*").alias("n")), "labelled")


def vocabulary_buckets(counts: DataFrame, points: int) -> DataFrame:
    """Log-spaced bucket of each token, from counts per label."""
    freq = settle(counts.groupBy("token").agg(F.sum("n").alias("freq")), "freq")
    return settle(bucketize(freq, points), "buckets")


def _lift(cells: DataFrame, keys: list[str], priors: DataFrame) -> DataFrame:
    """Share of each (label, key) cell over the product of its two marginal shares."""
    cells = settle(cells, "cells")
    margin = cells.groupBy(*keys).agg(F.sum("n").alias("n_key"))
    total = cells.agg(F.sum("n")).scalar()
    lift = (F.col("n") / total) / ((F.col("n_key") / total) * F.col("prior"))
    return (
        cells.join(margin, keys)
        .join(priors.select("label", "prior"), "label")
        .select("label", *keys, "n", lift.alias("lift"), F.log2(lift).alias("log2_lift"))
    )


def bucket_lift(df: DataFrame, label: str, text: str, points: int = 25) -> DataFrame:
    """How much more often than by chance a label's tokens fall into each frequency bucket.

    Label shares count rows (empty texts too), bucket shares count tokens.
    """
    counts = labelled_counts(df, label, text)
    buckets = vocabulary_buckets(counts, points)
    cells = counts.join(buckets.select("token", "bucket"), "token").groupBy("label", "bucket").agg(
        F.sum("n").alias("n")
    )
    priors = label_prior(df.select(F.col(label).alias("label")), "label")
    return _lift(cells, ["bucket"], priors)


def _coverage(hits: DataFrame, keys: list[str], df: DataFrame, label: str) -> DataFrame:
    sizes = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("size"))
    cells = hits.groupBy("label", *keys).agg(F.count("*").alias("n"))
    return cells.join(sizes, "label").select("label", *keys, (F.col("n") / F.col("size")).alias("coverage"))


def bucket_coverage(df: DataFrame, key: str, label: str, text: str, points: int = 25) -> DataFrame:
    """Share of each label's rows that contain the bucket at least once."""
    buckets = vocabulary_buckets(labelled_counts(df, label, text), points)
    tokens = F.array_distinct(field_tokens(text))
    rows = unnest(df, [key, F.col(label).alias("label")], tokens)
    hits = token_buckets(rows, buckets).select(key, "label", "bucket").distinct()
    return _coverage(hits, ["bucket"], df, label)


def _pair_histograms(df: DataFrame, key: str, label: str, text: str, points: int) -> DataFrame:
    buckets = vocabulary_buckets(labelled_counts(df, label, text), points)
    named = df.select(key, F.col(label).alias("label"), text)
    return bucket_histogram(named, key, ["label"], field_tokens(text), buckets)


def pair_cells(df: DataFrame, key: str, label: str, text: str, points: int = 25) -> DataFrame:
    """Ordered token pairs (i = j included) of all rows, counted per label and bucket pair.

    Each row contributes the products of its bucket counts, so a long text costs buckets squared, not
    tokens squared.
    """
    hist = _pair_histograms(df, key, label, text, points)
    return ordered_pairs(hist, ["label"]).groupBy("label", "b1", "b2").agg(F.sum("n").alias("n"))


def pair_lift(df: DataFrame, key: str, label: str, text: str, points: int = 25) -> DataFrame:
    """The lift of bucket pairs."""
    priors = label_prior(df.select(F.col(label).alias("label")), "label")
    return _lift(pair_cells(df, key, label, text, points), ["b1", "b2"], priors)


def pair_coverage(df: DataFrame, key: str, label: str, text: str, points: int = 25) -> DataFrame:
    """Share of each label's rows that contain the ordered bucket pair."""
    hist = _pair_histograms(df, key, label, text, points)
    return _coverage(ordered_pairs(hist, ["label"]), ["b1", "b2"], df, label)


def lift_and_coverage(
    df: DataFrame, key: str, label: str, text: str, points: int = 25, pairs: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Lift and coverage of buckets, or of ordered bucket pairs, from one count of the rows' histograms.

    The corpus is tokenised once for the buckets and once for the histograms, whatever is reported.
    """
    hist = _pair_histograms(df, key, label, text, points)
    keys = ["b1", "b2"] if pairs else ["bucket"]
    items = ordered_pairs(hist, ["label"]) if pairs else hist.select("label", F.explode("hist").alias("x")).select("label", "x.*")
    cells = settle(items.groupBy("label", *keys).agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "cells")
    priors = settle(label_prior(df.select(F.col(label).alias("label")), "label"), "priors")
    sizes = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("size"))
    coverage = cells.join(sizes, "label").select("label", *keys, (F.col("rows") / F.col("size")).alias("coverage"))
    return _lift(cells.select("label", *keys, "n"), keys, priors), coverage


def lift_topk(lift: DataFrame, coverage: DataFrame, keys: list[str], k: int, every: int = 1) -> DataFrame:
    """Best ``k`` cells of every label by lift, with their coverage; ``every=2`` drops mirrored pairs.

    The window runs over at most labels x buckets rows.
    """
    by_lift = W.partitionBy("label").orderBy(F.desc(F.round("lift", 9)), *keys)
    ranked = lift.withColumn("rank", F.row_number().over(by_lift)).where(
        (F.col("rank") <= k) & ((F.col("rank") - 1) % every == 0)
    )
    return ranked.join(coverage, ["label", *keys]).select("label", "rank", *keys, "lift", "coverage")


def bucket_counts(
    df: DataFrame, key: str, label: str, text: str, seed: int, points: int = 25, first: int = 4
) -> DataFrame:
    """Token counts of the first buckets per label, over equally many random tokens of each label.

    The sample is exact in size: the first tokens of each label by a hash of (row, token, occurrence).
    """
    buckets = vocabulary_buckets(labelled_counts(df, label, text), points)
    rows = unnest(df, [key, F.col(label).alias("label")], field_tokens(text))
    counts = rows.groupBy(key, "label", "token").agg(F.count("*").alias("n"))
    cells = settle(token_buckets(counts, buckets), "cells")
    quota = cells.groupBy("label").agg(F.sum("n").alias("n")).agg(F.min("n")).first()[0]
    each = cells.select("label", "bucket", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("i"), key, "token")
    digest = hash_key(seed, key, "token", "i")
    drawn = take_first(each, digest, [key, "token", "i"], quota, ["label"]).where(F.col("bucket") <= first)
    return drawn.groupBy("label").pivot("bucket", list(range(1, first + 1))).count().select(
        "label", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"bucket_{i}") for i in range(1, first + 1)]
    )


def pair_matrix(cells: DataFrame) -> DataFrame:
    """Each pair cell over the diagonal cell of its larger bucket, 0 where that is empty."""
    cells = settle(cells, "cells")
    diagonal = cells.where("b1 = b2").select("label", F.col("b1").alias("top"), F.col("n").alias("d"))
    joined = cells.withColumn("top", F.greatest("b1", "b2")).join(
        settle(diagonal, "diagonal"), ["label", "top"], "left"
    )
    return joined.select("label", "b1", "b2", F.coalesce(F.col("n") / F.col("d"), F.lit(0.0)).alias("ratio"))


def matrix_diff(matrix: DataFrame) -> DataFrame:
    """Difference of the matrices of every pair of labels; a missing cell counts as 0."""
    matrix = settle(matrix, "matrix")
    cells = matrix.groupBy("b1", "b2").agg(F.map_from_entries(F.collect_list(F.struct("label", "ratio"))).alias("m"))
    cells = cells.withColumn("labels", matrix.agg(F.array_sort(F.collect_set("label"))).scalar())
    pairs = F.flatten(
        F.transform(
            "labels",
            lambda x: F.transform(
                F.filter("labels", lambda y: y > x),
                lambda y: F.struct(
                    x.alias("l1"),
                    y.alias("l2"),
                    (
                        F.coalesce(F.element_at("m", x), F.lit(0.0))
                        - F.coalesce(F.element_at("m", y), F.lit(0.0))
                    ).alias("diff"),
                ),
            ),
        )
    )
    return cells.select("b1", "b2", F.explode(pairs).alias("p")).select("p.l1", "p.l2", "b1", "b2", "p.diff")


def unit_vectors(emb: DataFrame, key: str, value: str, name: str = "u") -> DataFrame:
    """Vectors scaled to length 1; a null vector stays null-length 0."""
    doubles = F.transform(value, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
    return emb.select(key, F.transform(doubles, lambda x: x / F.greatest(norm, F.lit(1e-6))).alias(name))


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine_pairs(
    emb: DataFrame, key: str, value: str, pairs: DataFrame, first: str, second: str, names: DataFrame | None = None
) -> DataFrame:
    """Cosine of every given pair of rows; a row paired with itself is left out.

    With ``names (src, dst)``, such as a swap map, both rows are called by their other name in the result;
    a row without one is an error.
    """
    unit = unit_vectors(emb, key, value)
    if names is not None:
        missing = F.raise_error(F.concat(F.lit("no name for row "), F.col(key).cast("string")))
        called = names.select(F.col("src").alias(key), F.col("dst").alias("_name"))
        unit = unit.join(called, key, "left").withColumn("_name", F.coalesce("_name", missing.cast(names.schema["dst"].dataType)))
    else:
        unit = unit.withColumn("_name", F.col(key))
    left = unit.select(F.col(key).alias(first), F.col("u").alias("_a"), F.col("_name").alias("_first"))
    right = unit.select(F.col(key).alias(second), F.col("u").alias("_b"), F.col("_name").alias("_second"))
    return (
        pairs.where(F.col(first) != F.col(second))
        .join(left, first)
        .join(right, second)
        .select(F.col("_first").alias(first), F.col("_second").alias(second), dot("_a", "_b").alias("cos"))
    )


def _gram(vectors: DataFrame, sides: list[str]) -> np.ndarray:
    """Count, sums and products of all components: the Gram matrix of ``[1, *sides]`` over all rows.

    Each task adds up its batches by matrix products and sends one matrix; its size is the square of the
    dimension, whatever the number of rows, and so is what the driver holds.
    """

    def partial(batches):
        total = None
        for batch in batches:
            m = np.hstack([np.ones((len(batch), 1)), *[np.stack(batch[s]) for s in sides]]) if len(batch) else None
            if m is not None:
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"m": [total.ravel()]})

    cells = vectors.select(*sides).mapInPandas(partial, "m array<double>").select(F.posexplode("m").alias("i", "x"))
    sums = cells.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").select("x").toPandas()["x"].to_numpy()
    width = math.isqrt(len(sums))
    return sums.reshape(width, width)


def _usable(side: str) -> Column:
    """Vectors that are there, with all components."""
    return F.col(side).isNotNull() & ~F.exists(side, F.isnull)


def _per_row(df: DataFrame, key: str, sides: list[str], names: list[str], score) -> DataFrame:
    """Statistics of each row against all others from the Gram matrix; null for rows without a vector.

    ``score`` gets the matrices of a batch, the sums and products, and the number of other rows.
    """
    usable = F.lit(True)
    for side in sides:
        usable = usable & _usable(side)
    vectors = df.where(F.coalesce(usable, F.lit(False)))
    gram = _gram(vectors, sides)
    kinds = T.StructType([df.schema[key], *[T.StructField(n, T.DoubleType()) for n in names]])
    if not len(gram):
        return df.select(key, *[F.lit(None).cast("double").alias(n) for n in names])

    def scored(batches):
        for batch in batches:
            if len(batch):
                values = score([np.stack(batch[s]) for s in sides], gram, gram[0, 0] - 1)
                yield pd.DataFrame({key: batch[key]} | dict(zip(names, values)))

    found = vectors.select(key, *sides).mapInPandas(scored, kinds)
    rest = df.where(~F.coalesce(usable, F.lit(False)))
    return found.unionByName(rest.select(key, *[F.lit(None).cast("double").alias(n) for n in names]))


def _form(left: np.ndarray, gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left @ gram) * right).sum(axis=1)


def proximity_stats(emb: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and standard deviation of the cosine of each row to all other rows.

    All pairs enter, none is formed: the sums over the other rows follow from the sum of the unit vectors
    and of their products. A row without others, or without a vector, gets nulls.
    """

    def score(sides, gram, others):
        (u,) = sides
        own = (u * u).sum(axis=1)
        s1, s2 = u @ gram[0, 1:] - own, _form(u, gram[1:, 1:], u) - own * own
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = s1 / others
            return mean, np.sqrt(np.maximum(s2 / others - mean * mean, 0.0))

    return _per_row(settle(unit_vectors(emb, key, value), "unit"), key, ["u"], ["mean_cos", "std_cos"], score)


def proximity_corr(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Pearson correlation, per row, of its cosines to all other rows in two embedding matrices.

    As above, the five sums behind the correlation come from moments of the joined unit vectors. A row
    without variation gets null.
    """

    def score(sides, gram, n):
        u, v = sides
        d = u.shape[1] + 1
        own_u, own_v = (u * u).sum(axis=1), (v * v).sum(axis=1)
        x, y = u @ gram[0, 1:d] - own_u, v @ gram[0, d:] - own_v
        xx = _form(u, gram[1:d, 1:d], u) - own_u * own_u
        yy = _form(v, gram[d:, d:], v) - own_v * own_v
        xy = _form(u, gram[1:d, d:], v) - own_u * own_v
        spread = np.sqrt(np.maximum(n * xx - x * x, 0.0)) * np.sqrt(np.maximum(n * yy - y * y, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            return (np.where(spread > 0, (n * xy - x * y) / spread, np.nan),)

    both = unit_vectors(first, key, value, "u").join(unit_vectors(second, key, value, "v"), key)
    return _per_row(settle(both, "both"), key, ["u", "v"], ["corr"], score)


def selectivity(df: DataFrame) -> DataFrame:
    """Probe and control scores relative to the task's best score over the layers, and their gap in percent."""
    best = df.groupBy("task").agg(F.max(F.greatest("probe", "control")).alias("best"))
    scaled = df.join(best, "task").select(
        "task", "layer", (F.col("probe") / F.col("best")).alias("probe"), (F.col("control") / F.col("best")).alias("control")
    )
    gap = F.round((F.col("control") - F.col("probe")) * 100 / F.col("control"), 1)
    return scaled.withColumns({"drop_pct": gap, "selectivity": -gap})


def rel_change(df: DataFrame, original: str, changed: str) -> DataFrame:
    """Percent by which the score on rewritten data differs, relative to that score."""
    pct = F.round((F.col(changed) - F.col(original)) * 100 / F.col(changed), 1)
    return df.withColumn("change_pct", pct)


def zero_shot_change(df: DataFrame, task: str, order: str, score: str) -> DataFrame:
    """Percent by which each setting differs from the task's first setting."""
    first = df.groupBy(task).agg(F.min_by(score, order).alias("base"))
    pct = F.round((F.col(score) - F.col("base")) * 100 / F.col("base"), 1)
    return df.join(first, task).select(task, order, score, pct.alias("change_pct"))


def probe_rows(df: DataFrame, keep: list[str], token: str, split: str, mapping: DataFrame, control: DataFrame) -> DataFrame:
    """Word-identity probe: swapped tokens with the original word and a random control word as labels.

    Test rows survive only with a label that the training rows have; each label is checked on its own.
    Which labels the training rows have is settled on the vocabulary, so the corpus meets one table; the one count of the
    tokens that tells it also weighs them for the join.
    ``mapping`` is ``(src, dst)`` and ``control`` is ``(dst, label)``.
    """
    tokens = df.select(*keep, split, F.col(token).alias("token"))
    is_train = F.col(split) == "train"
    counts = tokens.groupBy("token").agg(F.count("*").alias("freq"), F.max(F.when(is_train, True)).alias("seen"))
    pairs = settle(
        mapping.select(F.col("dst").alias("token"), F.col("src").alias("word"))
        .join(control.select(F.col("dst").alias("token"), F.col("label").alias("control")), "token")
        .join(counts, "token", "left")
        .withColumn("freq", F.coalesce("freq", F.lit(0))),
        "labels",
    )
    labels = pairs.drop("seen")
    for kind in ("word", "control"):
        known = pairs.where("seen").select(kind).distinct().withColumn(f"{kind}_known", F.lit(True))
        labels = labels.join(known, kind, "left")
    labels = settle(labels, "labels")
    choices = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("label"), F.col(f"{kind}_known").alias("known"))
            for kind in ("word", "control")
        ]
    )
    rows = join_by_token(tokens, labels).select(*keep, split, "token", F.explode(choices).alias("c"))
    return rows.where(is_train | F.col("c.known")).select(*keep, split, "token", "c.kind", "c.label")
