"""The corpus operators against plain versions, and their defined cases."""

import hashlib
import random
import re
import zlib

import compare
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from wordmill.llm import components, decontaminate, jaccard, langid, licences, pieces, pii, quality, topk, toxicity, warc
from wordmill.llm.common import new_path
from wordmill.llm.queries import MODEL, QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score string, label string, n long"
ODD = [(1, None, None, None, None, 1), (None, "a b c d e f g h", "en", "x", "y", 2), (2, "", "de", None, None, 3), (3, "x" * 200_000, None, None, None, 4), (4, " \n\t ", "", None, None, 5), (3, "x" * 200_000, None, None, None, 4), (5, "ÉÀ ß! 日本 ▁ \u0000", "fr", None, None, 6)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    want = compare.connect(FOLDER).execute(SQL[name]).df()
    got = QUERIES[name](spark, FOLDER).toPandas()
    for c in got:  # a column of nulls only has no kind of its own
        if got[c].isna().all():
            got[c], want[c] = got[c].astype(object), want[c].astype(object)
    assert compare.difference(got, want) is None


def held(name, label, share):
    import duckdb

    got = QUERIES[name](held.spark, "/root/testdata/sf0.01").toPandas()
    if label == "lang":
        told = duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").df()
        both = got.merge(told)
        both = both[both.held_out]
        assert (both.lang == both.lang_pred).mean() >= share
    else:
        told = duckdb.sql(f"select doc_id, {label} as y from '/root/testdata/sf0.01/labels.parquet'").df()
        both = got.merge(told)
        both = both[both.held_out]
        assert (both.predicted == both.y).mean() >= share
    assert got.score.between(0, 1).all()
    parts, left = {"toxic": (4, 2), "quality": (3, 1), "lang": (4, 2)}[label]
    assert all((zlib.crc32(str(d).encode()) % parts == left) == h for d, h in zip(got.doc_id, got.held_out, strict=True))


@pytest.mark.parametrize(("name", "label", "share"), [("op1_toxicity", "toxic", 0.88), ("op3_quality", "quality", 0.95), ("op4_langid", "lang", 0.97)])
def test_held_out(spark, name, label, share):
    held.spark = spark
    held(name, label, share)


def test_classifiers_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, y int")
    for docs in (odd, empty):
        for op in (toxicity, quality):
            rows = op.score(docs, op.fit(odd, labels, "y")).collect()
            assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
            assert len(op.score(docs, op.fit(empty, labels, "y")).collect()) == docs.count()
        found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(odd, odd)).collect()}
        assert all(found.get(i, "und") == "und" for i in (1, 2, 4))
        assert all(r["lang_pred"] == "und" for r in langid.predict(docs, langid.fit(empty, empty)).collect())


def test_jaccard_large_group(spark):
    """One group of 300 near copies, far more than a block, and chance copies, against all pairs."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = []
    for _ in range(300):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 30))) for _ in range(100)]
    texts += ["a b c", "A B  c", "a b", "", None, "a b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs, settings=jaccard.Settings(block=32, frequent=8, one_of=2)).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("frequent", [32, 0])
def test_jaccard_links_a_set_without_slack_to_a_larger_one(spark, frequent):
    """Six of seven shingles are 85.7 percent; five of six are not enough."""
    texts = [" ".join(f"{g}{i}" for i in range(n)) for g in "abc" for n in (8, 9, 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs, settings=jaccard.Settings(frequent=frequent)).collect()}
    assert got == {3 * g + i: (5 + i, 3 * g + min(i, 1)) for g in range(3) for i in range(3)}


def test_jaccard_odd(odd, empty):
    rows = jaccard.classes(odd).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in rows) == [(0, 5, None), (1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (4, 0, 4), (5, 2, 5)]  # five words, so two shingles
    assert jaccard.classes(empty).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 20)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


@pytest.mark.parametrize("few", [0, 40, 1 << 16])
def test_few_links_take_no_rounds(spark, monkeypatch, few):
    """Whether links are followed by rounds, by rounds until few are left, or at once, the components are the same."""
    rng = random.Random(5)
    links = [(x, x + 1) for x in range(0, 60) if x % 20 != 19] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(70, 70)]
    want = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in want:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    rounds = []
    real = components.settle
    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(components, "settle", lambda df, name: rounds.append(name) or real(df, name))
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want
    assert ("small" in rounds) == (few < len(links))


def test_pieces_equal_library():
    codec = pieces.Codec(open(public_tokenizers.path(MODEL), "rb").read())
    texts = ["", " ", "  a", "a  ", "\n\n a\n", "▁x ▁ y", "日本語 \u0000 ok", "😀é́", "c\t\td\r\n", " " * 50 + "x", "the the\nthe"]
    ids, ends, per = codec.encode(pa.array(texts))
    assert codec.decode(ids.astype(np.int64), per) == [codec.library.decode(codec.library.encode(t)) for t in texts]
    at = np.concatenate([[0], np.cumsum(per)])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == codec.library.encode(t)
        own = ends[at[i] : at[i + 1]].tolist()
        assert own == sorted(own) and (own[-1] if own else 0) == len(t.encode())
    assert codec.decode(np.array([1, 300, 2, 230]), np.array([4])) == [codec.library.decode([1, 300, 2, 230])]


def test_charmap_longest_prefix():
    """A hand-made double array: 'a' -> 'x', 'ab' -> 'yz', nothing else."""
    units = [0] * 1024
    jump = lambda node, to: (node ^ to) << 10

    units[0] = jump(0, 256)
    a = 256 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | jump(a, 600)
    units[600] = 0 | 1 << 31
    b = 600 ^ ord("b")
    units[b] = ord("b") | 1 << 8 | jump(b, 900)
    units[900] = 2 | 1 << 31
    raw = np.array(units, "<u4").tobytes()
    chars = pieces.CharMap(len(raw).to_bytes(4, "little") + raw + b"x\0yz\0")
    assert chars.longest(b"abc", 0) == (2, b"yz") and chars.longest(b"ac", 0) == (1, b"x") and chars.longest(b"c", 0) is None
    codec = pieces.Codec(open(public_tokenizers.path(MODEL), "rb").read())
    codec.chars, codec.parts = chars, False
    text, align = codec.normalise("c ab")
    assert text == "▁c▁yz" and align.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 2, 4]


def test_pieces_query(spark, odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = pieces.digests(odd, public_tokenizers.path(MODEL)).collect()
    want = sorted((len(i), sha(",".join(map(str, i))), sha(library.decode(i))) for i in (library.encode(r[1] or "") for r in ODD))
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert pieces.digests(empty, public_tokenizers.path(MODEL)).count() == 0


def test_decontaminate(spark, odd, empty):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    item = " ".join(rng.choice(words) for _ in range(60))
    items = spark.createDataFrame([(1, item), (2, "one two three"), (3, None), (4, "!!")], "item_id long, text string")
    changed = item.split()
    changed[30] = "other"
    few = item.split()
    few[::7] = ["other"] * len(few[::7])
    clean = " ".join(rng.choice(words) for _ in range(500))
    texts = [clean, f"{clean}. {item.upper()}! {clean}", f"x {' '.join(changed)}", f"x {' '.join(few)}", "so One, two three.", "one two", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [x["item"] for x in r["leaks"]] for r in decontaminate.mark(docs, items).collect()}
    assert got == {0: [], 1: [1], 2: [1], 3: [], 4: [2], 5: [], 6: [], 7: []}
    assert decontaminate.mark(odd, items).where("size(leaks) > 0").count() == 0
    assert decontaminate.mark(empty, items).count() == 0 and decontaminate.mark(odd, items.limit(0)).count() == len(ODD)


def test_decontaminate_index_is_complete():
    """The index names every fingerprint within the radius, and hardly any other: the bits differ in the most even way and in random ways."""
    rng = np.random.default_rng(1)
    bits = decontaminate.WIDTH * 8
    base = rng.integers(0, 256, (1, decontaminate.WIDTH), dtype=np.uint8)
    flips = np.zeros((301, bits), np.uint8)
    for row in flips[1:]:
        row[rng.choice(bits, decontaminate.RADIUS, replace=False)] = 1
    flips[0, np.r_[np.arange(decontaminate.RADIUS) // 3 * 8 + np.arange(decontaminate.RADIUS) % 3]] = 1
    items = base ^ np.packbits(flips, axis=1)
    w, i = decontaminate.named(decontaminate.tables(items), base, len(items))
    assert not w.any() and i.tolist() == list(range(301))


def test_decontaminate_index_selects():
    """Fewer than one in a hundred of 20,000 unrelated fingerprints of one size go on to the exact distance."""
    rng = np.random.default_rng(2)
    items = rng.integers(0, 256, (20_000, decontaminate.WIDTH), dtype=np.uint8)
    index = decontaminate.tables(items)
    w, i = decontaminate.named(index, rng.integers(0, 256, (64, decontaminate.WIDTH), dtype=np.uint8), len(items))
    assert index.nbytes < 32 << 20 and len(w) < 0.01 * 64 * len(items)
    w, i = decontaminate.named(index, items[:50], len(items))
    assert {(x, x) for x in range(50)} <= set(zip(w.tolist(), i.tolist(), strict=True))


def test_pii(spark, odd, empty):
    text = "mail a.b@c.de now, 10.0.0.255 and 300.1.1.1, card 4111 1111 1111 1111 or 4111111111111112, +49 (30) 123-45678; IBAN DE89 3704 0044 0532 0130 00."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.report(docs).first()
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1) and "iban" in row["spans"]
    clean = pii.redact(docs).first()["text"]
    assert clean.startswith("mail <email> now, <ip> and 300.1.1.1, card <card> or 4111111111111112, <phone>; IBAN <iban>")
    assert pii.report(odd).where("spans = ''").count() == len(ODD) and pii.redact(empty).count() == 0
    long = spark.createDataFrame([(1, "a" * 100_000 + "1" * 100_000)], "doc_id long, text string")
    assert pii.report(long).first()["spans"] == ""


def test_licences(spark, odd, empty):
    text = "Copyright (c) 2020 X\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.\nReleased under the MIT License. Licensed under CC BY-NC 4.0."
    row = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["licences"] == "MIT;CC-BY-NC-4.0" and row["identifiers"].startswith("<copyright><mit-grant>")
    assert licences.scan(odd).where("licences <> ''").count() == 0 and licences.scan(empty).count() == 0
    assert all(any(cue in s for cue in licences.CUES) for k, s in licences.SENTENCES.items() if k not in ("x",)), [s for s in licences.SENTENCES.values() if not any(c in s for c in licences.CUES)]


def test_warc(spark):
    same = "p" * 1500
    pages = spark.createDataFrame([(1, "u1", same), (2, "u2\r\nx", same), (3, None, "q" * 10), (4, "u4", None), (None, "u5", same)], "page_id long, url string, html string")
    at = new_path(spark, "warc")
    warc.write(warc.records(pages).repartition(2), at)
    found = warc.read(spark, at)
    assert sorted((r["record_id"] or "", r["record_type"], r["refers_to"] or "", r["payload_length"]) for r in found.collect()) == [
        ("", "revisit", "<urn:page:2>", 1500), ("<urn:page:1>", "revisit", "<urn:page:2>", 1500), ("<urn:page:2>", "response", "", 1500),
        ("<urn:page:3>", "response", "", 10), ("<urn:page:4>", "response", "", 0),
    ]
    only = found.where("record_type = 'revisit' AND target_uri = 'u1'")
    assert only.count() == 1 and "Filter" not in only._jdf.queryExecution().optimizedPlan().toString().replace("FilterExec", "").split("RelationV2")[0].replace("isnotnull", "")
    assert warc.read(spark, at, payload=False).where(F.col("payload").isNotNull()).count() == 0
    none = new_path(spark, "warc")
    warc.write(warc.records(pages.limit(0)), none)
    assert warc.read(spark, none).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(400)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, []), (None, [0.1] * 8), (7, [0.5] * 8), (500, [0.2, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, F.col("vec_id") % 50 == 0, "vec_id", "v", 5).collect())
    have = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, v in have:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in have if i != q and len(w) == len(v))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.search(df.limit(0), F.lit(True), "vec_id", "v", 5).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, FOLDER)
        if name != "pieces":
            assert kept.columns == docs.columns
    assert 0 < kept.count() <= docs.count()
    assert docs.join(kept, "doc_id", "left_anti").count() + kept.select("doc_id").distinct().count() == docs.count()
