"""A training corpus from raw documents: every stage works on what the one before has kept.

    run(spark, "/data/folder")     # the folder holds documents, labels and benchmark as Parquet

Stages take (spark, docs, folder) and return a table; ``run`` writes each result to the folder that the cluster names
in ``spark.checkpoint.dir`` and reads it back, so a lost executor repeats one stage at most. All but the last return the columns
of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import decontaminate, jaccard, pieces, pii, toxicity
from wordmill.llm.common import fold, fresh, settle, table
from wordmill.llm.queries import MODEL


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the model, learned from the labelled ones outside the held-out fold, does not reject."""
    learn = table(spark, folder, "labels").where(fold("doc_id", 4) != 2)
    model = toxicity.fit(table(spark, folder, "documents"), learn, "toxic")
    [score] = fresh(docs, "toxicity")
    return toxicity.mark(docs, model, score).where(F.col(score) < 0.3).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each class of similar texts: the one with the smallest id.

    Rows that share their id with others, and rows without one, are told apart by numbers above all ids, so they are
    judged by their texts like all others; such a row stays only if its class has no row with an id of its own.
    """
    [key] = fresh(docs, "key")
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    shared = settle(ids.where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("id")), "shared")
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    if not shared.isEmpty():
        same = docs["doc_id"].eqNullSafe(shared["id"])
        above = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
        others = settle(docs.join(shared, same, "left_semi").withColumn(key, F.monotonically_increasing_id() + above), "others")
        keyed = keyed.join(shared, same, "left_anti").unionByName(others)
    first = jaccard.classes(keyed, key).where(F.col(key) == F.col("component_id")).select(key)
    return keyed.join(first, key, "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    [leaks] = fresh(docs, "leaks")
    marked = decontaminate.mark(docs, table(spark, folder, "benchmark"), to=leaks)
    return marked.where(F.size(leaks) == 0).select(*docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with the ids of their text and the source byte at which each piece ends."""
    return pieces.encode(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_copies),
    ("decontaminate", drop_leaks),
    ("pii", hide_private),
    ("pieces", encode),
]

#: Classifier, fingerprints and pieces are beyond SQL; tests/llm/test_run.py has the plain version of all stages after the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, folder), name)
    return docs
