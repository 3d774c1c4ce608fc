"""What the operators share: folds, bounded samples of labelled rows, settled tables."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.operators.scale import SHARES_PER_TASK, new_path, settle, task_count

__all__ = ["arrow", "fold", "fresh", "new_path", "settle", "spread_join", "table", "labelled_sample"]


#: Bytes that a task hands to Python at a time, unless the session says less.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The same rows; the session hands them to Python in batches of bounded size."""
    said = df.sparkSession.conf.get(BATCH_SETTING, None)
    if said is None or not said.rstrip("b").isdigit() or not 0 < int(said.rstrip("b")) <= BATCH_BYTES:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over batches of bounded size."""
    return bounded(df).mapInArrow(function, schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added to those that a column of the table has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled texts (key, text, label), one for each chosen key.

    Keys are taken by the smallest hash. A sixteenth of the places is dealt evenly to the labels first, so that a rare one is not lost among
    many rows: of each label the keys whose hash lies in the lowest part that is expected to hold its share. A key with several texts gives the one with the smallest
    hash, found before anything is shuffled, so the bound holds however often a key occurs. Labels are counted only, never
    ranked; their counts (at most a sixteenth of ``rows``) and the chosen keys are broadcast, and texts that are not chosen do not move.
    """
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(label).cast("string").alias("_label"))
    )
    share = rows // 16 // max(1, known.agg(F.count_distinct("_label")).first()[0])
    place = F.xxhash64("_key")
    first = F.lit(False)
    if share:
        counts = known.groupBy("_label").agg(F.count("*").alias("_n"))
        known = known.join(F.broadcast(counts), "_label")
        first = (place / F.lit(2.0**64) + 0.5) * F.col("_n") < share
    chosen = known.orderBy(F.desc(first), place, "_key").limit(rows).select("_key", "_label")
    picked = docs.select(F.col(key).alias("_key"), F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(chosen), "_key")
    one = picked.groupBy("_key").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("text"), F.max("_label").alias("label"))
    return one.select(F.col("_key").alias("key"), "text", "label")


def spread_join(rows: DataFrame, told: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Equi-join of rows with a settled table that has one row for each key and says in ``weight`` how many rows have it.

    Nulls equal each other. A key with more than a share of a task's rows is salted by its weight; there are fewer such keys
    than shares, so they are broadcast. ``rows`` and ``told`` have no other columns in common; the weight is not returned.
    """
    shares = SHARES_PER_TASK * task_count(rows.sparkSession)
    share = (told.agg(F.sum(weight)).first()[0] or 0) // shares + 1
    salts = F.ceil(F.col(weight) / share).cast("int")
    hot = F.broadcast(told.where(F.col(weight) > share).select(*[F.col(c).alias(f"_hot{i}") for i, c in enumerate(on)], salts.alias("_salts")))
    match = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_hot{i}")) for i, c in enumerate(on)])
    left = rows.join(hot, match, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_salts", F.lit(1))).cast("int"))
    copies = told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(weight) > share, salts - 1).otherwise(0))))
    copies = copies.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(on)], F.col("_salt").alias("_its"), *[c for c in told.columns if c not in (*on, weight)])
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(on)], F.col("_salt") == F.col("_its"))
    return left.join(copies, same, how).select(*rows.columns, *[c for c in told.columns if c not in (*on, weight)])
