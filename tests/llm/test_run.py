"""The pipeline and the learned operators beside plain versions of them."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from wordmill.llm import decontaminate, langid, pii, quality, queries, toxicity
from wordmill.llm.queries import MODEL

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_first(docs):
    """Ids that stay when of linked texts (four-word shingles, 85 in 100) the smallest id stays."""
    words = {i: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) for i, text in docs.items()}
    sets = {i: {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set() for i, w in words.items()}
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i for i in ids if top(i) == i}


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_shingles(words):
    return [tuple(words[i : i + min(5, len(words))]) for i in range(max(1, len(words) - 4))] if words else []


def plain_leaks(docs, items):
    """Greatest similarity of every text with every item over all windows of the item's size, or over a shorter text as a whole."""
    texts = {i: plain_words(t) for i, t in items.items()}
    holders = Counter(s for words in {tuple(w) for w in texts.values() if w} for s in set(plain_shingles(list(words))))
    out = {}
    for i, words in texts.items():
        if not words:
            continue
        own = set(plain_shingles(words))
        weight = lambda s, cap: min(1 / holders[s] if s in holders else 1.0, cap)
        cap = 2.0 ** math.floor(math.log2(sum(weight(s, 1.0) for s in own) / len(own)) + 1e-9)
        total = sum(weight(s, cap) for s in own)
        k = min(5, len(words))
        for d, text in docs.items():
            w = plain_words(text)
            every = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            best = 0.0
            if not own & set(every):
                continue
            for a in range(max(1, len(w) - len(words) + 1)):
                window = set(every[a : a + len(words) - k + 1])
                common = sum(weight(s, cap) for s in window & own)
                if common:
                    best = max(best, common / (total + sum(weight(s, cap) for s in window) - common))
            out[d, i] = best
    return out


def planted(rng):
    """Items, and texts with copies of them in which one word in 8 to 60 is another."""
    word = lambda: f"w{rng.randrange(400)}"
    items = {i: " ".join(word() for _ in range(rng.choice((7, 12, 30, 31, 60)))) for i in range(12)}
    items[12] = items[3] + " more"
    docs = {}
    for d in range(60):
        piece = items[rng.randrange(13)].split()
        every = rng.choice((8, 15, 25, 60))
        changed = [word() if j % every == every - 1 else x for j, x in enumerate(piece)]
        docs[d] = " ".join([*(word() for _ in range(rng.randrange(40))), *changed, *(word() for _ in range(rng.randrange(40)))])
    return items, docs


def test_decontaminate_equals_all_windows(spark):
    """Every pair from 0.85 on is found with its similarity, and none below 0.8."""
    items, docs = planted(random.Random(3))
    known = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {(r["doc_id"], x["item"]): x["similarity"] for r in decontaminate.mark(rows, known).collect() for x in r["leaks"]}
    want = plain_leaks(docs, items)
    assert len(got) > 20 and all(abs(want[p] - s) < 1e-9 and s >= 0.8 - 1e-9 for p, s in got.items())
    assert {p for p, s in want.items() if s >= 0.85} <= set(got)


def test_pipeline_equals_plain_stages(spark):
    """run() keeps and writes what plain versions of the stages do with the documents that the classifier lets pass."""
    got = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, FOLDER).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    clean = {r["doc_id"] for r in queries.QUERIES["op1_toxicity"](spark, FOLDER).collect() if not r["predicted"]}
    texts = {i: t for i, t in texts.items() if i in clean}
    texts = {i: texts[i] for i in plain_first(texts)}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    leaks = plain_leaks(texts, items)
    assert not any(0.8 - 1e-9 <= s < 0.85 for s in leaks.values()), "pairs at which the fingerprints may decide either way"
    texts = {i: t for i, t in texts.items() if max((s for (d, _), s in leaks.items() if d == i), default=0) < 0.8}
    assert set(got) == set(texts)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    patterns = [pii.PLAIN["email"], pii.PLAIN["ip"]]
    for i, row in got.items():
        assert row["n_chars"] == len(row["text"]) and list(row["ids"]) == library.encode(row["text"])
        for m in re.finditer(patterns[0], texts[i]):
            assert m[0] not in row["text"]
        if not any(re.search(p, texts[i]) for p in patterns) and not re.search("[0-9]{4}", texts[i]):
            assert row["text"] == texts[i]


def test_copies_that_share_an_id_or_have_none(spark):
    long = lambda name: " ".join(f"{name}{j}" for j in range(60))
    rows = [(1, long("a")), (2, long("a")), (2, long("b")), (3, long("b") + " x"), (4, long("c")), (4, long("c")), (4, long("d")), (None, long("d")), (None, long("a")), (None, long("e")), (None, None), (5, ""), (2, long("f"))]
    docs = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_copies(spark, docs, FOLDER)
    got = Counter((r["text"] or "")[:3] for r in kept.collect())
    assert got == Counter({"a0 ": 1, "b0 ": 1, "c0 ": 1, "d0 ": 1, "e0 ": 1, "f0 ": 1, "": 2})
    ids = {(r["text"] or "")[:3]: r["doc_id"] for r in kept.collect() if r["text"]}
    assert ids["a0 "] == 1 and ids["b0 "] == 3 and kept.columns == docs.columns
    assert corpus_pipeline.drop_copies(spark, docs.limit(0), FOLDER).count() == 0


def test_updates_equal_the_published_rule():
    """Follow-the-regularised-leader, one coordinate at a time, in plain numbers."""
    s = toxicity.Settings(bits=6)
    state, rng = toxicity.Ftrl(s), random.Random(2)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        l1 = 0 if i == 64 else s.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(400):
        at, y = [*rng.sample(range(64), rng.randrange(1, 9)), 64], rng.randrange(2)
        state.learn(np.array(at), y)
        w = [weight(i) for i in at]
        g = 1 / (1 + math.exp(-sum(w))) - y
        for i, x in zip(at, w, strict=True):
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * x
            n[i] += g * g
    assert np.allclose(state.weights(np.arange(65)), [weight(i) for i in range(65)], rtol=1e-9, atol=1e-12)
    assert (state.weights(np.arange(65)) != 0).any()


@pytest.mark.parametrize("known", [3, 25, 400])
def test_votes_equal_all_cosines(known):
    """Neighbours by exact cosines, of equal ones the first, each weighing its cosine."""
    rng = np.random.default_rng(known)
    vectors = quality.unit(rng.integers(-3, 4, (known, 5)).astype(np.float32))
    rows = quality.unit(rng.integers(-3, 4, (700, 5)).astype(np.float32))
    labels = rng.integers(0, 2, known).astype(float)
    s = quality.Settings()
    got = quality.vote(rows, quality.Model(s, np.zeros(0), np.zeros((0, 0)), vectors, labels))
    cosines = rows @ vectors.T
    for row, c in enumerate(cosines):
        best = sorted(range(known), key=lambda j: (-c[j], j))[: s.neighbours]
        total = sum(max(c[j], 0) for j in best)
        want = sum(max(c[j], 0) * labels[j] for j in best) / total if total > 0 else labels.mean()
        assert abs(got[row] - want) < 1e-4, row


def test_language_is_voted_within_the_family():
    """The family of the greatest evidence, then the language with most won duels, of equal ones the greater sum of margins."""
    rng = np.random.default_rng(9)
    s = langid.Settings(width=64, rounds=40, families={"x": ("a", "b", "c"), "y": ("d", "e")})
    centre = {name: rng.random(64) * 4 + 6 * (np.arange(64) % 2 == (name in "de")) for name in "abcdef"}
    names = [name for name in "abcdef" for _ in range(12)]
    rows = np.stack([rng.poisson(centre[name]) for name in names]).astype(np.float32)
    model = langid.learn(rows, names, s)
    best, score = langid.judge(rows, model)
    assert np.mean([model.languages[b] == n for b, n in zip(best, names, strict=True)]) > 0.9 and ((score >= 0) & (score <= 1)).all()
    scaled = langid.unit(rows)
    for row in range(len(rows)):
        evidence = [sum(math.log1p(x) * p for x, p in zip(rows[row], model.profile[f], strict=True)) + model.prior[f] for f in range(len(model.families))]
        family = model.families[int(np.argmax(evidence))]
        members = [i for i, name in enumerate(model.languages) if s.family(name) == family]
        margin = {pair: float(scaled[row] @ plane[:-1] + plane[-1]) for pair, plane in zip(model.pairs, model.planes, strict=True)}
        won = Counter(a if margin[a, b] >= 0 else b for a, b in margin if a in members)
        most = max(won.values(), default=0)
        assert best[row] in [i for i in members if won[i] == most], row
