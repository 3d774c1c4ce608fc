"""Evaluation metrics from tables of gold and predicted labels."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordmill.functions import fixed
from wordmill.functions.arrays import unnest
from wordmill.functions.hashing import hash_unit
from wordmill.operators.scale import cumulated, join_by_token, settle


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(df: DataFrame, gold: str = "gold", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Row counts per (gold, predicted) label: the only pass over the rows, combined before the shuffle."""
    return df.groupBy(*(by or []), F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("n")
    )


def class_scores(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion counts."""
    by = by or []
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("gold").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit")),
            )
        ).alias("s"),
    )
    sums = sides.groupBy(*by, F.col("s.label").alias("label")).agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.hit").alias("hit")
    )
    return sums.select(
        *by,
        "label",
        "hit",
        "predicted",
        ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def classification_report(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Per-class rows, then accuracy, macro and support-weighted averages."""
    scores = settle(class_scores(confusion(df, gold, pred)), "scores")
    each = scores.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    accuracy = F.sum("hit") / total
    overall = scores.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"), accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), total.alias("support")),
            F.struct(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support")),
            F.struct(
                F.lit("weighted avg").alias("label"),
                (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
                (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
                (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"),
                total.alias("support"),
            ),
        ).alias("rows")
    )
    return each.unionByName(overall.select(F.explode("rows").alias("r")).select("r.*"))


def mcc_of(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Matthews correlation of any number of classes, from per-class hits and margins."""
    d = lambda c: F.col(c).cast("double")
    sums = scores.groupBy(*(by or [])).agg(
        F.sum(d("hit")).alias("c"),
        F.sum(d("support")).alias("s"),
        F.sum(d("predicted") * d("support")).alias("pt"),
        F.sum(d("predicted") * d("predicted")).alias("pp"),
        F.sum(d("support") * d("support")).alias("tt"),
    )
    s2 = F.col("s") * F.col("s")
    spread = F.sqrt(s2 - F.col("pp")) * F.sqrt(s2 - F.col("tt"))
    value = ratio(F.col("c") * F.col("s") - F.col("pt"), spread)
    return sums.select(*(by or []), value.alias("mcc"))


def mcc(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return mcc_of(class_scores(confusion(df, gold, pred)))


def average_ranks(cells: DataFrame, col: str, name: str) -> DataFrame:
    """Add to ``(col, ..., n)`` the rank of each value among all ``n`` rows, ties sharing their average rank.

    Only distinct values are ordered: a value's rank is the number of rows before it plus half its own.
    Values with many cells are salted when the ranks are too large to broadcast.
    """
    values = cells.groupBy(col).agg(F.sum("n").alias("_rows"), F.count("*").alias("freq"))
    placed = cumulated(values, [F.col(col)], "_rows", "_before")
    rank = F.col("_before") + (F.col("_rows") + 1) / 2
    ranks = settle(placed.select(col, rank.alias(name), "freq"), "ranks")
    return join_by_token(cells, ranks, on=col).drop("freq")


def spearman(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Pearson correlation of the average ranks, over the rows that have both values.

    The rows are counted per (gold, predicted) value once; all else works on those counts.
    """
    both = df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    cells = settle(confusion(both, gold, pred), "cells")
    ranked = average_ranks(average_ranks(cells, "gold", "rg"), "pred", "rp")
    middle = (cells.agg(F.sum("n")).scalar() + 1) / 2
    x, y, n = F.col("rg") - F.col("_middle"), F.col("rp") - F.col("_middle"), F.col("n")
    sums = ranked.withColumn("_middle", middle).agg(
        F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy")
    )
    spread = F.sqrt("xx") * F.sqrt("yy")
    return sums.select(F.when(spread > 0, F.col("xy") / spread).alias("spearmanr"))


def task_metrics(df: DataFrame, task: str, key: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """The metrics that a benchmark task reports, as (metric, value); several ones also get their mean."""
    names = fixed.TASK_METRICS[task]
    parts = []
    if {"accuracy", "f1", "matthews_correlation"} & set(names):
        scores = settle(class_scores(confusion(df, gold, pred)), "scores")
        if "accuracy" in names:
            parts.append(scores.agg((F.sum("hit") / F.sum("support")).alias("value")).withColumn("metric", F.lit("accuracy")))
        if "f1" in names:
            positive = F.max(F.when(F.col("label") == 1, F.col("f1")))
            parts.append(scores.agg(F.coalesce(positive, F.lit(0.0)).alias("value")).withColumn("metric", F.lit("f1")))
        if "matthews_correlation" in names:
            parts.append(mcc_of(scores).select(F.col("mcc").alias("value"), F.lit("matthews_correlation").alias("metric")))
    if "pearson" in names:
        parts.append(df.agg(F.corr(gold, pred).alias("value")).withColumn("metric", F.lit("pearson")))
    if "spearmanr" in names:
        parts.append(spearman(df, gold, pred).select(F.col("spearmanr").alias("value"), F.lit("spearmanr").alias("metric")))
    table = parts[0].select("metric", "value")
    for part in parts[1:]:
        table = table.unionByName(part.select("metric", "value"))
    if len(parts) > 1:
        table = settle(table, "metrics")
        table = table.unionByName(table.agg(F.avg("value").alias("value")).select(F.lit("combined_score").alias("metric"), "value"))
    return table


def mean_squared_error(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    gap = F.col(pred).cast("double") - F.col(gold).cast("double")
    return df.agg(F.avg(gap * gap).alias("mse"))


def flat_tags(df: DataFrame, gold: str, pred: str, ignore: int | None = None) -> DataFrame:
    """One row per tagged position; ignored gold tags are dropped."""
    pairs = unnest(df, [], F.arrays_zip(F.col(gold).alias("gold"), F.col(pred).alias("pred")), "z")
    flat = pairs.select("z.gold", "z.pred")
    return flat if ignore is None else flat.where(F.col("gold") != ignore)


def token_report(df: DataFrame, gold: str, pred: str, ignore: int | None = -100) -> DataFrame:
    """Macro F1 and accuracy over all positions."""
    scores = settle(class_scores(confusion(flat_tags(df, gold, pred, ignore))), "scores")
    return scores.agg(F.avg("f1").alias("f1"), (F.sum("hit") / F.sum("support")).alias("accuracy"))


def flat_f1(df: DataFrame, gold: str, pred: str, labels: list | None = None) -> DataFrame:
    """Micro-averaged F1 over the given labels."""
    scores = class_scores(confusion(flat_tags(df, gold, pred)))
    if labels is not None:
        scores = scores.where(F.col("label").isin(labels))
    micro = ratio(2 * F.sum("hit"), F.sum("support") + F.sum("predicted"))
    return scores.agg(micro.alias("f1"))


def spans(tags: Column) -> Column:
    """Entity spans (type, first, last) of a tag array.

    A span starts at a B tag, after O, or where the type changes, and ends before the next O or start.
    Starts and ends are found per position and matched by order, in one pass within the row.
    """
    kind = lambda t: F.when(t == "O", F.lit("")).otherwise(F.regexp_replace(t, "^[A-Z]-", ""))
    n = F.size(tags)
    at = lambda i: F.when(i.between(0, n - 1), F.element_at(tags, i + 1)).otherwise(F.lit("O"))
    starts = lambda i: (at(i) != "O") & (
        at(i).startswith("B-") | (at(i - 1) == "O") | (kind(at(i - 1)) != kind(at(i)))
    )
    ends = lambda i: (at(i) != "O") & ((at(i + 1) == "O") | starts(i + 1))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.zip_with(
        F.filter(places, starts),
        F.filter(places, ends),
        lambda s, e: F.struct(kind(F.element_at(tags, s + 1)).alias("type"), s.alias("first"), e.alias("last")),
    )


def _spans(codes: np.ndarray, rows: np.ndarray, first: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entity spans (row, first, last, kind) of the tags of all rows, given by codes; code 0 is outside.

    The rule is that of ``spans``.
    """
    inside = codes > 0
    before, behind = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    same = rows[1:] == rows[:-1]
    before[1:] = same & inside[:-1]
    turn = np.ones(len(codes), bool)
    turn[1:] = kind[codes[1:]] != kind[codes[:-1]]
    starts = inside & (begins[codes] | ~before | turn)
    behind[:-1] = same & inside[1:] & ~starts[1:]
    s, e = np.flatnonzero(starts), np.flatnonzero(inside & ~behind)
    return rows[s], s - first[rows[s]], e - first[rows[s]], kind[codes[s]]


def _span_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of every type in gold, in predicted tags and in both; under the null type the positions, and those alike."""
    for batch in batches:
        batch = batch.filter(pc.and_(batch["g"].is_valid(), batch["p"].is_valid()))  # a filter in the plan would make the tags twice
        sides = [batch["g"], batch["p"]]
        tags = pa.concat_arrays([x.flatten() for x in sides]).fill_null("O").dictionary_encode()
        names = ["O", *tags.dictionary.to_pylist()]
        kinds = ["" if x == "O" else re.sub("^[A-Z]-", "", x) for x in names]
        types = list(dict.fromkeys(kinds))
        kind = np.array([types.index(x) for x in kinds])
        begins = np.array([x.startswith("B-") for x in names])
        codes = np.array([0 if x == "O" else i for i, x in enumerate(names)])[tags.indices.to_numpy(zero_copy_only=False) + 1]
        size = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in sides]
        first = [np.cumsum(n) - n for n in size]
        rows = [np.repeat(np.arange(len(n)), n) for n in size]
        codes = np.split(codes, [len(rows[0])])
        gold, pred = (_spans(codes[i], rows[i], first[i], kind, begins) for i in (0, 1))
        starts = [row << 32 | at for row, at, _, _ in (gold, pred)]  # ascending
        j = np.searchsorted(starts[1], starts[0])
        i = np.flatnonzero(j < len(starts[1]))
        i = i[starts[0][i] == starts[1][j[i]]]
        alike = i[(gold[2][i] == pred[2][j[i]]) & (gold[3][i] == pred[3][j[i]])]
        counts = [np.bincount(x, minlength=len(types)) for x in (gold[3], pred[3], gold[3][alike])]
        place = np.arange(len(rows[0])) - first[0][rows[0]]
        both = np.flatnonzero(place < size[1][rows[0]])
        there = first[1][rows[0][both]] + place[both]
        valid = [x.flatten().is_valid().to_numpy(zero_copy_only=False) for x in sides]
        same = int((valid[0][both] & valid[1][there] & (codes[0][both] == codes[1][there])).sum())
        seen = [t for t in range(len(types)) if counts[0][t] or counts[1][t]]
        columns = [[types[t] for t in seen] + [None], *[[int(c[t]) for t in seen] + [x] for c, x in zip(counts, (len(rows[0]), 0, same), strict=True)]]
        yield pa.record_batch([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["type", "support", "predicted", "hit"])


def span_report(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of entity spans, per type and overall, and token accuracy.

    The rows are passed once, spans of a batch are found at once on its tags' codes, and a batch sends one count for each type.
    Rows without gold or predicted tags take no part, a null tag counts as outside and equals none.
    """
    both = df.select(F.col(gold).alias("g"), F.col(pred).alias("p"))
    items = both.mapInArrow(_span_counts, "type string, support long, predicted long, hit long")
    sides = ("support", "predicted", "hit")
    found = settle(items.groupBy("type").agg(*[F.sum(c).alias(c) for c in sides]), "spans")
    counts = found.where("type IS NOT NULL")
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sides])
    rows = counts.unionByName(total.withColumn("type", F.lit("overall")))
    accuracy = found.where("type IS NULL").agg(F.try_divide(F.sum("hit"), F.sum("support"))).scalar()
    return rows.select(
        "type",
        ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        F.when(F.col("type") == "overall", accuracy).alias("accuracy"),
    )


def cumulative_priors(df: DataFrame, label: str) -> DataFrame:
    """One row with the sorted labels and the cumulated share up to each (one entry per class)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    upto = W.orderBy("label").rowsBetween(W.unboundedPreceding, 0)
    shares = counts.select("label", F.sum("n").over(upto).alias("c"), F.sum("n").over(W.partitionBy()).alias("t"))
    items = F.array_sort(F.collect_list(F.struct("label", (F.col("c") / F.col("t")).alias("upto"))))
    return shares.agg(items.alias("items"))


def draw_label(items: Column, u: Column) -> Column:
    """Label whose cumulated share is the first above ``u``."""
    below = F.size(F.filter(items, lambda i: i["upto"] <= u))
    return F.element_at(items, F.least(below + 1, F.size(items)))["label"]


def random_confusion(df: DataFrame, key: str, label: str, runs: int, seed: int) -> DataFrame:
    """Confusion counts (run, gold, pred, n) of stratified random guesses for every row and run.

    Every row and run has a digest of its own, of seed, run and key, as in ``hash_unit``; the guess is the first label whose
    cumulated share exceeds its uniform number. A task counts its rows' guesses in arrays and sends one row for each run and pair of labels, so the runs
    are never unnested. The label shares, one entry per class, go to the tasks.
    """
    priors = settle(cumulative_priors(df, label), "priors")
    items = priors.first()["items"] or []
    place, upto = {x["label"]: i for i, x in enumerate(items)}, np.array([x["upto"] for x in items])
    heads = [f"{seed}|{run}" for run in range(1, runs + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(place)
        counts: dict[int, int] = {}
        for batch in batches:
            gold = np.array([place[x] for x in batch["gold"].to_pylist()], np.int64)
            ends = ["" if k is None else f"|{k}" for k in batch["key"].to_pylist()]
            digests = b"".join(hashlib.md5((head + end).encode()).digest()[:4] for end in ends for head in heads)
            u = np.frombuffer(digests, ">u4").reshape(len(gold), runs) / 2.0**32
            pred = np.minimum(np.searchsorted(upto, u, side="right"), size - 1)
            codes, n = np.unique((np.arange(runs) * size + gold[:, None]) * size + pred, return_counts=True)
            for c, m in zip(codes.tolist(), n.tolist()):
                counts[c] = counts.get(c, 0) + m
        codes = list(counts)
        columns = [[c // size // size + 1 for c in codes], [c // size % size for c in codes], [c % size for c in codes]]
        yield pa.record_batch([*(pa.array(x, pa.int32()) for x in columns), pa.array([counts[c] for c in codes], pa.int64())], ["run", "gold", "pred", "n"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(label).alias("gold"))
    found = rows.mapInArrow(count, "run int, gold int, pred int, n long").groupBy("run", "gold", "pred").agg(F.sum("n").alias("n"))
    said = lambda c: F.element_at("items", F.col(c) + 1)["label"].alias(c)
    return found.withColumn("items", priors.scalar()).select("run", said("gold"), said("pred"), "n")


def random_baseline(df: DataFrame, key: str, label: str, runs: int = 100, seed: int = 42) -> DataFrame:
    """Mean and sample deviation of macro F1 and Matthews correlation over random guesses."""
    scores = settle(class_scores(random_confusion(df, key, label, runs, seed), ["run"]), "scores")
    per_run = scores.groupBy("run").agg(F.avg("f1").alias("f1")).join(mcc_of(scores, ["run"]), "run")
    return per_run.agg(
        F.count("*").alias("runs"),
        F.avg("f1").alias("mean_f1"),
        F.stddev_samp("f1").alias("std_f1"),
        F.avg("mcc").alias("mean_mcc"),
    )


def random_tags(df: DataFrame, key: str, tags: str, seed: int) -> DataFrame:
    """Tag arrays with a random tag at every position, drawn from the tag shares of the table."""
    flat = unnest(df, [], F.col(tags), "label")
    items = settle(cumulative_priors(flat, "label"), "priors").scalar()
    drawn = F.transform(F.col(tags), lambda _, i: draw_label(F.col("_items"), hash_unit(seed, key, i)))
    return df.withColumn("_items", items).withColumn("pred_tags", drawn).drop("_items")


def perplexity(df: DataFrame, loss: str) -> DataFrame:
    return df.agg(F.exp(F.avg(loss)).alias("perplexity"))


def exact_match(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Percent of rows whose prediction equals the label."""
    hit = (F.col(gold) == F.col(pred)).cast("double")
    return df.agg((F.avg(hit) * 100).alias("exact_match"))
