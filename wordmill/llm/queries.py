"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import decontaminate, jaccard, langid, licences, neardup, pieces, pii, quality, topk, toxicity, turns, vectorcodes, warc
from wordmill.llm.common import fold, new_path, table

#: Model file of the registered tokenizer query.
MODEL = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    docs = table(spark, folder, "documents")
    learn = table(spark, folder, "labels").where(fold("doc_id", 4) != 2)
    scored = toxicity.score(docs, toxicity.fit(docs, learn, "toxic"))
    return scored.withColumn("held_out", fold("doc_id", 4) == 2)


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items in every document: how many, the best one, its similarity and its bytes."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.mark(docs, table(spark, folder, "benchmark")).drop("text")
    best = F.try_element_at("leaks", F.lit(1))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).cast("int").alias("contaminated"),
        F.size("leaks").cast("long").alias("n_items"),
        best["item"].alias("item_id"),
        F.coalesce(best["similarity"], F.lit(0.0)).alias("similarity"),
        best["start"].alias("start_byte"),
        best["end"].alias("end_byte"),
    )


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, by the votes of labelled documents outside the held-out fold."""
    docs = table(spark, folder, "documents")
    learn = table(spark, folder, "labels").where(fold("doc_id", 3) != 1)
    scored = quality.score(docs, quality.fit(docs, learn, "quality"))
    return scored.withColumn("held_out", fold("doc_id", 3) == 1)


def op4_langid(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, folder, "documents")
    learn = docs.where(fold("doc_id", 4) != 2).select("doc_id", "lang")
    return langid.predict(docs, langid.fit(docs, learn)).withColumn("held_out", fold("doc_id", 4) == 2)


def op5_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence statements of every document."""
    return licences.scan(table(spark, folder, "documents"))


def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return pieces.digests(table(spark, folder, "documents"), public_tokenizers.path(MODEL))


def op7_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents that a Jaccard similarity of 0.85 on four-word shingles connects."""
    return jaccard.classes(table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The pages written as archives and read back; revisits give what their response and headers say."""
    at = new_path(spark, "warc")
    warc.write(warc.records(table(spark, folder, "pages")), at)
    both = warc.read(spark, at).where(F.col("record_type").isin("response", "revisit"))
    told = F.replace(F.col("payload_digest"), F.lit("sha1:"), F.lit(""))
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    return both.select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(told).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op9_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    rows = table(spark, folder, "embeddings").where(topk.usable(F.col("embedding")))
    rows = rows.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.search(rows, F.col("vec_id") % 50 == 0, "vec_id", "v", 5)


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    return pii.report(table(spark, folder, "documents"))


def op11_vectorcodes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of every vector in four parts with 256 entries each."""
    return vectorcodes.encode(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")


def op12_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged conversations: their faults, the cheapest repair and a digest of what it gives."""
    rows = turns.turns(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    return turns.digested(turns.repair(turns.damage(rows))).withColumnRenamed("conv", "conv_id")


def op13_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors that a cosine of 0.95 connects."""
    return neardup.dedup(table(spark, folder, "embeddings"), "vec_id", "embedding")


QUERIES |= {"op1_toxicity": op1_toxicity, "op2_decontaminate": op2_decontaminate, "op3_quality": op3_quality, "op4_langid": op4_langid, "op5_licences": op5_licences, "op6_pieces": op6_pieces, "op7_jaccard": op7_jaccard, "op8_warc": op8_warc, "op9_topk": op9_topk, "op10_pii": op10_pii, "op11_vectorcodes": op11_vectorcodes, "op12_turns": op12_turns, "op13_neardup": op13_neardup}
SQL |= {"op5_licences": licences.SQL, "op7_jaccard": jaccard.SQL, "op8_warc": warc.SQL, "op9_topk": topk.SQL, "op10_pii": pii.SQL, "op11_vectorcodes": vectorcodes.SQL, "op12_turns": turns.SQL, "op13_neardup": neardup.SQL}
