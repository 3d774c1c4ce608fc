"""Bag-of-words and frequency-bucket features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.functions.arrays import unnest
from wordmill.functions.text import basic_tokens, is_present
from wordmill.operators.scale import join_by_token, numbered, settle
from wordmill.operators.vocab import field_tokens, token_buckets


def bow(df: DataFrame, key: str, cols: list[str], index: DataFrame) -> DataFrame:
    """Sparse word counts ``(key, idx, cnt)``; the second field of a pair is offset by the vocabulary size.

    The rows are partitioned by ``key`` while they are compact; counting per row and the lookup of a
    small index keep that partitioning. Words are counted before they meet the index, so a row sends each
    distinct word once to a large one. Words outside the index are dropped.
    """
    size = index.count() if len(cols) > 1 else 0
    tagged = [_field_words(at, c) for at, c in enumerate(cols)]
    counts = (
        unnest(df.repartition(key), [key], F.concat(*tagged), "t")
        .groupBy(key, "t.field", "t.token")
        .agg(F.count("*").alias("cnt"))
    )
    hits = join_by_token(counts, index, once=True)
    return hits.select(key, (F.col("idx") + F.col("field") * size).alias("idx"), "cnt")


def _field_words(field: int, col: str) -> Column:
    tokens = F.coalesce(field_tokens(col), F.array().cast("array<string>"))
    return F.transform(tokens, lambda t: F.struct(F.lit(field).alias("field"), t.alias("token")))


def cut_tokens(col: str, max_len: int) -> Column:
    return F.slice(basic_tokens(col), 1, max_len)


def bucket_bow(
    df: DataFrame, key: str, col: str, buckets: DataFrame, max_len: int = 128, binary: bool = True
) -> DataFrame:
    """Frequency-bucket features of the first ``max_len`` tokens: which buckets occur, or how often."""
    rows = unnest(df.repartition(key), [key], cut_tokens(col, max_len))
    counts = rows.groupBy(key, "token").agg(F.count("*").alias("n"))
    sums = token_buckets(counts, buckets).groupBy(key, "bucket").agg(F.sum("n").alias("cnt"))
    value = F.lit(1).cast("bigint") if binary else F.col("cnt")
    return sums.select(key, F.col("bucket").alias("idx"), value.alias("cnt"))


def bucket_histogram(df: DataFrame, key: str, keep: list[str], tokens: Column, buckets: DataFrame) -> DataFrame:
    """Per row one array of (bucket, count), at most as long as there are buckets.

    Tokens are counted by bucket where they meet it, so neither the texts are shuffled nor the distinct tokens of
    rows held; at most as many counts leave a row as there are buckets.
    """
    rows = unnest(df, [key, *keep], tokens)
    sums = token_buckets(rows, buckets).groupBy(key, *keep, "bucket").agg(F.count("*").alias("n"))
    return sums.groupBy(key, *keep).agg(
        F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("hist")
    )


def unordered_pairs(hist: Column) -> Column:
    """Token pairs i < j of one row as (b1 <= b2, count), from its bucket histogram alone."""
    pairs = F.flatten(
        F.transform(
            hist,
            lambda x: F.transform(
                F.filter(hist, lambda y: y["bucket"] >= x["bucket"]),
                lambda y: F.struct(
                    x["bucket"].alias("b1"),
                    y["bucket"].alias("b2"),
                    F.when(
                        x["bucket"] == y["bucket"],
                        F.floor(x["n"] * (x["n"] - 1) / 2).cast("bigint"),
                    )
                    .otherwise(x["n"] * y["n"])
                    .alias("n"),
                ),
            ),
        )
    )
    return F.filter(pairs, lambda p: p["n"] > 0)


def ordered_pairs(hist: DataFrame, keep: list[str]) -> DataFrame:
    """Token pairs (i, j), i = j included, of every row with a ``hist`` as (keep, b1, b2, n); no array of pairs is made."""
    first = hist.select(*keep, "hist", F.explode("hist").alias("x"))
    both = first.select(*keep, "x", F.explode("hist").alias("y"))
    return both.select(*keep, F.col("x.bucket").alias("b1"), F.col("y.bucket").alias("b2"), (F.col("x.n") * F.col("y.n")).alias("n"))


def pair_ranks(df: DataFrame, key: str, col: str, buckets: DataFrame) -> DataFrame:
    """Corpus count of every unordered bucket pair and the 0-based dense rank of that count."""
    hist = bucket_histogram(df, key, [], F.when(is_present(col), basic_tokens(col)), buckets)
    counts = settle(
        hist.select(F.explode(unordered_pairs(F.col("hist"))).alias("p"))
        .groupBy("p.b1", "p.b2")
        .agg(F.sum("p.n").alias("n")),
        "pairs",
    )
    levels = numbered(counts.select("n").distinct(), [F.col("n")], name="idx", start=0)
    return counts.join(levels, "n").select("b1", "b2", "n", "idx")


def pair_bow(df: DataFrame, key: str, col: str, buckets: DataFrame, max_len: int = 128) -> DataFrame:
    """Second-order features of the first ``max_len`` tokens: count per rank of the pair's corpus count."""
    ranks = settle(pair_ranks(df, key, col, buckets).select("b1", "b2", "idx"), "ranks")
    hist = bucket_histogram(df, key, [], cut_tokens(col, max_len), buckets)
    pairs = hist.select(key, F.explode(unordered_pairs(F.col("hist"))).alias("p")).select(
        key, "p.b1", "p.b2", "p.n"
    )
    return (
        pairs.join(ranks, ["b1", "b2"])
        .groupBy(key, "idx")
        .agg(F.sum("n").alias("cnt"))
    )
