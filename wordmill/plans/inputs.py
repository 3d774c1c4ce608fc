"""Inputs that the queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.functions.text import basic_tokens
from wordmill.operators.scale import settle
from wordmill.operators.vocab import doc_freq, term_freq, token_counts
from wordmill.operators.wordpiece import piece_vocabulary, pieces_of, vocab_table, wordpieces
from wordmill.session import load

SEED = 42


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents")


def split_column() -> Column:
    return F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train")


def split_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a split name and the order of the splits."""
    docs = documents(spark, folder).withColumn("split", split_column())
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    return docs.withColumn("split_ord", order)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with quality labels; predictions flip the label of every third text length."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    flipped = F.when(F.col("n_chars") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return documents(spark, folder).join(labels, "doc_id").withColumn("pred", flipped)


def languages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their language as gold label and a prediction that often says English."""
    guess = F.when(F.col("n_chars") % 4 == 0, "en").otherwise(F.col("lang"))
    return spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", F.col("lang").alias("gold"), guess.alias("pred")
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    talk = load(spark, folder, "conversations")
    ask = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("first"))
    reply = talk.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("second")
    )
    return ask.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("pair_id"), "first", "second"
    )


def frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Settled occurrence counts of the document words."""
    return settle(term_freq(documents(spark, folder), "text"), "freq")


def field_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Settled field counts of the document words."""
    return settle(doc_freq(documents(spark, folder), ["text"]), "freq")


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Settled document vocabulary in which every word counts as one piece."""
    return settle(vocab_table(doc_freq(documents(spark, folder), ["text"])), "vocab")


def piece_table(spark: SparkSession, folder: str) -> DataFrame:
    """Settled word-piece vocabulary of the documents."""
    return settle(piece_vocabulary(documents(spark, folder), "text"), "pieces")


def pieced_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Settled document vocabulary with piece counts; one pass over the texts counts fields and occurrences."""
    counts = settle(token_counts(documents(spark, folder), "text"), "counts")
    pieces = settle(pieces_of(counts.select("token", F.col("terms").alias("freq"))), "pieces")
    freq = counts.select("token", F.col("docs").alias("freq"))
    return settle(vocab_table(freq, wordpieces(freq, pieces)), "vocab")


def tokens(col: str = "text") -> Column:
    return basic_tokens(col)


def joined(array: Column | str) -> Column:
    """Arrays are compared as text."""
    arr = F.col(array) if isinstance(array, str) else array
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), " ")
