"""Vocabulary statistics: frequencies, ranks, indexes and frequency buckets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.functions.arrays import unnest, unnest_with_position
from wordmill.functions.hashing import hash_key
from wordmill.functions.text import basic_tokens, has_items, is_present
from wordmill.operators.scale import join_by_token, numbered, settle


def field_tokens(col: str, tokenised: bool = False) -> Column:
    """Token array of one text field; an empty field gives null."""
    return F.when(has_items(col), F.col(col)) if tokenised else F.when(is_present(col), basic_tokens(col))


def doc_freq(df: DataFrame, cols: list[str]) -> DataFrame:
    """Number of text fields that contain each token; the fields of a pair count separately."""
    fields = F.flatten(
        F.array_compact(F.array(*[F.array_distinct(field_tokens(c)) for c in cols]))
    )
    return unnest(df, [], fields).groupBy("token").agg(F.count("*").alias("freq"))


def term_freq(df: DataFrame, col: str, tokenised: bool = False) -> DataFrame:
    """Number of occurrences of each token."""
    return unnest(df, [], field_tokens(col, tokenised)).groupBy("token").agg(F.count("*").alias("freq"))


def token_counts(df: DataFrame, col: str) -> DataFrame:
    """Occurrences (``terms``) and fields (``docs``) of each token, from texts that are tokenised once.

    A field's tokens are sorted, and each is met with the one before it: it counts as a field where the two differ.
    """
    tokens = df.select(F.sort_array(field_tokens(col)).alias("t"))
    shifted = F.concat(F.array(F.lit(None).cast("string")), "t")
    met = unnest(tokens, [], F.arrays_zip("t", shifted.alias("last")), "z").where("z.t IS NOT NULL")
    new = F.coalesce(F.col("z.last") != F.col("z.t"), F.lit(True)).cast("bigint")
    return met.groupBy(F.col("z.t").alias("token")).agg(F.count("*").alias("terms"), F.sum(new).alias("docs"))


def frequency_order() -> list[Column]:
    """Most frequent first; ties in hash order, never alphabetically (neighbours look alike)."""
    return [F.desc("freq"), F.md5("token")]


def freq_rank(freq: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Position of every token in the frequency order."""
    return numbered(freq, frequency_order(), by)


def _row_place(df: DataFrame, split: str, row: str) -> Column | None:
    """Order of (split, row) as an integer with 31 free bits below it, null first; None if they are not integers or too far apart.

    The least of integers is found by hashing, the least of structs only by sorting all occurrences.
    """
    if not all(isinstance(df.schema[c].dataType, T.IntegralType) for c in (split, row)):
        return None
    (low, high), (first, last) = ((r[0], r[1]) for r in df.agg(*[F.struct(F.min(c), F.max(c)) for c in (split, row)]).first())
    if low is None or first is None:
        return None
    rows = (last - first + 2).bit_length()
    if (high - low + 2).bit_length() + rows + 31 > 63:
        return None
    place = lambda c, least: F.coalesce(F.col(c).cast("bigint") - F.lit(least - 1).cast("bigint"), F.lit(0).cast("bigint"))
    return F.shiftleft(F.shiftleft(place(split, low), rows) + place(row, first), 31)


def vocab_index(df: DataFrame, split: str, row: str, cols: list[str], tokenised: bool = False) -> DataFrame:
    """0-based index of each token by first appearance over (split order, row, position)."""
    fields = F.flatten(F.array_compact(F.array(*[field_tokens(c, tokenised) for c in cols])))
    place = _row_place(df, split, row)
    if place is None:
        seen = unnest_with_position(df, [split, row], fields)
        at = F.struct(F.col(split), F.col(row), F.col("pos"))
    else:
        seen = unnest_with_position(df, [place.alias("_place")], fields)
        at = F.col("_place") + F.col("pos")
    first = seen.groupBy("token").agg(F.min(at).alias("first"), F.count("*").alias("freq"))
    return numbered(first, [F.col("first")], name="idx", start=0).select("token", "idx", "freq")


def log_edges(freq: DataFrame, points: int) -> DataFrame:
    """One row with the upper edges of log-spaced frequency buckets (``points - 1`` of them)."""
    bounds = freq.agg(F.min("freq").alias("low"), F.max("freq").alias("high"))
    step = (F.log10("high") - F.log10("low")) / F.lit(points - 1)
    edge = lambda i: F.ceil(F.round(F.pow(F.lit(10.0), F.log10("low") + i * step), 9)).cast("bigint")
    return bounds.select(F.transform(F.sequence(F.lit(0), F.lit(points - 2)), edge).alias("edges"))


def bucket_of(freq: Column, edges: Column) -> Column:
    """1-based position of the first edge that is not below the frequency; the top bucket takes the rest."""
    return F.least(F.size(F.filter(edges, lambda e: e < freq)) + 1, F.size(edges))


def bucketize(freq: DataFrame, points: int) -> DataFrame:
    """Log-spaced bucket of every token."""
    cut = freq.withColumn("_edges", log_edges(freq, points).scalar())
    return cut.withColumn("bucket", bucket_of(F.col("freq"), F.col("_edges"))).drop("_edges")


def freq_of_freq(freq: DataFrame) -> DataFrame:
    """Number of distinct tokens at each frequency."""
    return freq.groupBy("freq").agg(F.count("*").alias("n_tokens"))


def dense_bucket(freq: DataFrame) -> DataFrame:
    """0-based bucket per distinct frequency, ascending."""
    levels = settle(numbered(freq_of_freq(freq), [F.col("freq")], name="bucket", start=0), "levels")
    return freq.join(levels.select("freq", "bucket"), "freq").select(
        "token", "freq", "bucket"
    )


def random_buckets(freq: DataFrame, n: int, seed: int) -> DataFrame:
    """Equal-size buckets of a shuffled vocabulary; the first ``size % n`` buckets get one more."""
    placed = settle(numbered(freq, [hash_key(seed, "token")], name="at", start=0), "placed")
    size = placed.count()
    small, extra = divmod(size, n)
    cut = extra * (small + 1)
    bucket = F.when(F.col("at") < cut, F.floor(F.col("at") / (small + 1))).otherwise(
        extra + F.floor((F.col("at") - cut) / max(small, 1))
    )
    return placed.select("token", "freq", bucket.cast("int").alias("bucket"))


def coarse_buckets(vocab: DataFrame, by: str = "n_pieces", min_size: int = 10) -> DataFrame:
    """Frequency buckets of at least ``min_size`` tokens, per group.

    Distinct frequencies are walked upwards; a bucket closes once it holds enough tokens, the remainder
    joins the last bucket. The walk runs over (frequency, count) pairs, never over tokens: a corpus of
    T tokens has fewer than sqrt(2T) distinct frequencies.
    """
    levels = vocab.groupBy(by, "freq").agg(F.count("*").alias("n"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("freq")
        ids, closed, held = [], 0, 0
        for n in group["n"]:
            ids.append(closed)
            held += n
            if held >= min_size:
                closed, held = closed + 1, 0
        group["bucket"] = np.minimum(ids, max(closed - 1, 0)).astype("int32")
        return group[[by, "freq", "bucket"]]

    kind = vocab.schema[by].dataType.simpleString()
    buckets = settle(
        levels.groupBy(by).applyInPandas(walk, f"{by} {kind}, freq bigint, bucket int"), "coarse"
    )
    return vocab.join(buckets, [by, "freq"]).select("token", "freq", by, "bucket")


def split_stats(df: DataFrame, split: str) -> DataFrame:
    """Number of rows per split."""
    return df.groupBy(split).agg(F.count("*").alias("n_rows"))


def label_prior(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of every label."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return counts.select(label, "n", (F.col("n") / total).alias("prior"))


def label_index(df: DataFrame, col: str, is_array: bool = False) -> DataFrame:
    """0-based ids of the sorted distinct labels."""
    values = unnest(df, [], F.array_distinct(F.col(col)), "label") if is_array else df.select(
        F.col(col).alias("label")
    )
    return numbered(values.where("label is not null").distinct(), [F.col("label")], name="id", start=0)


def swap_freq_diff(mapping: DataFrame, freq: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Absolute difference between the frequency of a word and that of its replacement."""
    target = freq if target is None else target
    source_side = freq.select(F.col("token").alias("src"), F.col("freq").alias("src_freq"))
    target_side = target.select(F.col("token").alias("dst"), F.col("freq").alias("dst_freq"))
    return (
        mapping.select("src", "dst")
        .join(source_side, "src")
        .join(target_side, "dst")
        .select("src", "dst", F.abs(F.col("src_freq") - F.col("dst_freq")).alias("freq_diff"))
    )


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts in equal-width bins between the extremes; the last bin is closed on the right."""
    bounds = df.agg(
        F.struct(F.min(col).cast("double").alias("low"), F.max(col).cast("double").alias("high"))
    ).scalar()
    width = (bounds["high"] - bounds["low"]) / F.lit(bins)
    at = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - bounds["low"]) / width), F.lit(bins - 1))
    )
    return df.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def token_buckets(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Attach the bucket of each token to corpus rows with a ``token`` column."""
    return join_by_token(rows, buckets.select("token", "bucket", "freq")).drop("freq")
