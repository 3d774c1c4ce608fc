"""Appended and replaced archives, bounded samples, names that clash."""

import hashlib
import random
import re
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordmill.llm import decontaminate, pieces, pii, toxicity, warc
from wordmill.llm.common import fresh, labelled_sample, new_path
from wordmill.llm.queries import MODEL


def test_archives_are_added_and_replaced(spark):
    at = new_path(spark, "warc")
    pages = lambda lo, hi: warc.records(spark.range(lo, hi).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), "id").alias("html")))
    ids = lambda: sorted(r["record_id"] for r in warc.read(spark, at).where("record_type = 'response'").collect())
    named = lambda lo, hi: sorted(f"<urn:page:{i}>" for i in range(lo, hi))
    warc.write(pages(0, 3), at)
    warc.write(pages(3, 7), at)
    assert ids() == named(0, 7)
    warc.write(pages(10, 12), at, mode="overwrite")
    assert ids() == named(10, 12)
    warc.write(pages(12, 13), at)
    assert ids() == named(10, 13)


def test_sample_is_bounded_and_keeps_rare_labels(spark):
    docs = spark.range(40_000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id").distinct().withColumn("y", F.when(F.col("doc_id") % 5000 == 0, "rare").otherwise("common"))
    got = labelled_sample(docs, labels, "doc_id", "y", 320).collect()
    assert len(got) == len({r["key"] for r in got}) == 320
    assert sum(r["label"] == "rare" for r in got) == labels.where("y = 'rare'").count() == 7
    few = labelled_sample(docs, labels.where("doc_id = 7"), "doc_id", "y", 10).collect()
    assert [(r["key"], r["label"]) for r in few] == [(7, "common")]
    many = labelled_sample(docs, labels.withColumn("y", F.col("doc_id")), "doc_id", "y", 50).collect()
    assert len(many) == 50
    assert labelled_sample(docs, labels.where("false"), "doc_id", "y", 10).collect() == []


CLASHES = ("_toxic", "_leaks", "_n", "_pii", "ids", "ends", "n", "leaks", "toxicity", "leaks_text", "_leaks0", "score", "key", "set", "class", "_text", "_key")


def test_stages_keep_clashing_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    docs = docs.withColumns({c: F.lit(f"is {c}") for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert got.columns[: len(docs.columns)] == docs.columns, name
        assert all(r[c] == f"is {c}" for r in got.select(*CLASHES).collect() for c in CLASHES), name
        assert got.columns[len(docs.columns) :] == (["ids_", "ends_"] if name == "pieces" else []), name


def test_names_that_are_taken(spark):
    docs = spark.createDataFrame([(1, "a@b.cc here", "x")], "doc_id long, text string, taken string")
    assert fresh(docs, "taken", "free", "Taken") == ["taken_", "free", "Taken__"]
    assert pii.redact(docs.withColumn("_pii", F.lit(1))).columns == ["doc_id", "text", "taken", "_pii"]
    assert pieces.encode(docs, public_tokenizers.path(MODEL), ids="taken").columns[-2:] == ["taken_", "ends"]
    items = spark.createDataFrame([(1, "some words of an item here")], "item_id long, text string")
    with pytest.raises(ValueError):
        decontaminate.mark(docs, items, to="taken")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, y int")
    with pytest.raises(ValueError):
        toxicity.mark(docs, toxicity.fit(docs, labels, "y"), "taken")


def plain_redact(text, found):
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"<{pii.KINDS[kind]}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_spans_across_blocks(spark):
    """Texts of 0 to 600 spans of all kinds, some of which overlap, with characters of several bytes between them."""
    rng = random.Random(5)
    bits = ["a@b.co ", "10.2.3.4 ", "+49 30 1234567 ", "4111111111111111 ", "é😀 ", "x.y@10.0.0.1 ", "DE89370400440532013000 ", "+4111111111111111 ", "999.1.1.1 "]
    texts = ["".join(rng.choices(bits, k=n)) for n in (0, 1, 15, 16, 17, 31, 33, 100, 255, 257, 600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["pii"]] for r in pii.find(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for i, text in enumerate(texts):
        emails = [(m.start(), 0, m.end()) for m in re.finditer(pii.PLAIN["email"], text)]
        ips = [(m.start(), 1, m.end()) for m in re.finditer(pii.PLAIN["ip"], text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [s for s in found[i] if s[1] < 2] == sorted(emails + ips), i
        assert found[i] == sorted(found[i]) and clean[i] == plain_redact(text, found[i]), i


def test_many_spans_in_one_text(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a@b.co, "), 50_000).alias("text"))
    begun = time.time()
    assert pii.report(docs).first()["n_email"] == 50_000
    assert pii.redact(docs).select(F.sha2("text", 256)).first()[0] == hashlib.sha256(("<email>, " * 50_000).encode()).hexdigest()
    print("seconds", time.time() - begun)
    assert time.time() - begun < 20
