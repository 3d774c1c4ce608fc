import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordmill.operators import assoc as A
from wordmill.operators import features as X
from wordmill.operators import metrics as M
from wordmill.operators import vocab as V
from wordmill.operators.scale import settle


def corpus(spark, n=30):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefgh", weights=[40, 20, 10, 5, 3, 2, 1, 1], k=rng.randint(0, 25))), i % 2) for i in range(n)]
    return rows, settle(spark.createDataFrame(rows, "id int, text string, label int"))


def test_log_buckets_follow_the_formula(spark):
    counts = list(range(1, 400, 3))
    freq = settle(spark.createDataFrame([(f"w{c}", c) for c in counts], "token string, freq bigint"))
    edges = [math.ceil(round(x, 9)) for x in np.logspace(math.log10(1), math.log10(max(counts)), 25)[:-1]]
    want = {f"w{c}": next((i + 1 for i, e in enumerate(edges) if c <= e), len(edges)) for c in counts}
    assert {r.token: r.bucket for r in V.bucketize(freq, 25).collect()} == want


def test_pair_features_equal_all_pairs(spark):
    rows, df = corpus(spark)
    buckets = settle(V.bucketize(settle(V.term_freq(df, "text")), 25))
    of = {r.token: r.bucket for r in buckets.collect()}
    pairs = lambda text: Counter(tuple(sorted((of[a], of[b]))) for a, b in itertools.combinations(text.split(), 2))
    totals = sum((pairs(t) for _, t, _ in rows), Counter())
    rank = {n: i for i, n in enumerate(sorted(set(totals.values())))}
    want = Counter()
    for i, text, _ in rows:
        for pair, n in pairs(" ".join(text.split()[:10])).items():
            want[(i, rank[totals[pair]])] += n
    got = X.pair_bow(df, "id", "text", buckets, max_len=10).collect()
    assert {(r.id, r.idx): r.cnt for r in got} == dict(want)


def test_pair_cells_and_coverage_equal_all_pairs(spark):
    rows, df = corpus(spark)
    of = {r.token: r.bucket for r in V.bucketize(settle(V.term_freq(df, "text")), 25).collect()}
    cells, cover = Counter(), Counter()
    for _, text, label in rows:
        ordered = [(of[a], of[b]) for a in text.split() for b in text.split()]
        cells.update((label, *p) for p in ordered)
        cover.update((label, *p) for p in set(ordered))
    got = A.pair_cells(df, "id", "label", "text").collect()
    assert {(r.label, r.b1, r.b2): r.n for r in got} == dict(cells)
    shares = A.pair_coverage(df, "id", "label", "text").collect()
    assert all(math.isclose(r.coverage, cover[(r.label, r.b1, r.b2)] / 15) for r in shares) and len(shares) == len(cover)


def test_lift_is_normalised(spark):
    _, df = corpus(spark)
    lift = A.bucket_lift(df, "label", "text").collect()
    total = sum(r.n for r in lift)
    for label in (0, 1):
        own = sum(r.n for r in lift if r.label == label) / total
        margin = {b: sum(r.n for r in lift if r.bucket == b) / total for b in {r.bucket for r in lift}}
        assert math.isclose(sum(r.lift * margin[r.bucket] * 0.5 for r in lift if r.label == label), own)


def test_sampled_bucket_counts_use_the_quota(spark):
    rows, df = corpus(spark)
    sizes = Counter()
    for _, text, label in rows:
        sizes[label] += len(text.split())
    got = A.bucket_counts(df, "id", "label", "text", 3, first=24).collect()
    assert {sum(r[f"bucket_{i}"] for i in range(1, 25)) for r in got} == {min(sizes.values())}


def test_proximity_by_moments_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 6)), rng.normal(size=(40, 6))
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id int, v array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    ca, cb = unit(a) @ unit(a).T, unit(b) @ unit(b).T
    for r in A.proximity_corr(frame(a), frame(b), "id", "v").collect():
        others = [j for j in range(40) if j != r.id]
        assert math.isclose(r["corr"], np.corrcoef(ca[r.id, others], cb[r.id, others])[0, 1], abs_tol=1e-9)
    for r in A.proximity_stats(frame(a), "id", "v").collect():
        others = ca[r.id, [j for j in range(40) if j != r.id]]
        assert math.isclose(r.mean_cos, others.mean(), abs_tol=1e-9) and math.isclose(r.std_cos, others.std(), abs_tol=1e-9)


def test_proximity_of_missing_and_single_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None])], "id int, v array<double>")
    assert {tuple(r) for r in A.proximity_stats(df, "id", "v").collect()} == {(i, None, None) for i in (1, 2, 3)}
    none = df.where("id > 5")
    assert A.proximity_stats(none, "id", "v").count() == 0 and A.proximity_corr(none, none, "id", "v").count() == 0


def test_cosines_under_other_names(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "id string, v array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a")], "x string, y string")
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "src string, dst string")
    (row,) = A.cosine_pairs(df, "id", "v", pairs, "x", "y", names).collect()
    assert (row.x, row.y) == ("A", "B") and math.isclose(row.cos, math.sqrt(0.5))
    with pytest.raises(Exception, match="no name"):
        A.cosine_pairs(df, "id", "v", pairs, "x", "y", names.where("src = 'a'")).collect()


def test_coarse_buckets_follow_the_walk(spark):
    rng = random.Random(3)
    rows = [(f"w{i}", int(rng.paretovariate(0.8)), i % 3) for i in range(300)] + [("x", 1, 9), ("y", 2, 9)]
    got = V.coarse_buckets(settle(spark.createDataFrame(rows, "token string, freq bigint, n_pieces int"))).collect()
    for group in (0, 1, 2, 9):
        counts = Counter(f for _, f, g in rows if g == group)
        want, closed, held = {}, 0, 0
        for f in sorted(counts):
            want[f] = closed
            held += counts[f]
            if held >= 10:
                closed, held = closed + 1, 0
        top = max(closed - 1, 0)
        assert all(r.bucket == min(want[r.freq], top) for r in got if r.n_pieces == group)


def test_random_buckets_are_even(spark):
    freq = spark.createDataFrame([(f"w{i}", 1) for i in range(103)], "token string, freq bigint")
    sizes = Counter(r.bucket for r in V.random_buckets(freq, 10, 1).collect())
    assert [sizes[i] for i in range(10)] == [11, 11, 11, 10, 10, 10, 10, 10, 10, 10]
    few = Counter(r.bucket for r in V.random_buckets(freq.limit(4), 10, 1).collect())
    assert few == {0: 1, 1: 1, 2: 1, 3: 1}


def test_spans(spark):
    cases = {
        "O": [], "B-X": [("X", 0, 0)], "B-X I-X O B-X": [("X", 0, 1), ("X", 3, 3)], "I-X I-X": [("X", 0, 1)],
        "B-X B-X": [("X", 0, 0), ("X", 1, 1)], "I-X I-Y O I-Y": [("X", 0, 0), ("Y", 1, 1), ("Y", 3, 3)], "": [],
    }
    df = spark.createDataFrame([(k.split(),) for k in cases], "t array<string>")
    got = df.select(M.spans(F.col("t")).alias("s")).collect()
    assert [[(s.type, s.first, s.last) for s in r.s] for r in got] == list(cases.values())


def test_span_report_counts_whole_spans(spark):
    df = spark.createDataFrame([("B-X I-X O B-Y".split(), "B-X O O B-Y".split())], "g array<string>, p array<string>")
    rows = {r.type: r for r in M.span_report(df, "g", "p").collect()}
    assert (rows["X"].f1, rows["Y"].f1, rows["overall"].precision, rows["overall"].accuracy) == (0.0, 1.0, 0.5, 0.75)


def test_matthews_of_several_classes(spark):
    rng = random.Random(6)
    pairs = [(rng.randint(0, 2), rng.randint(0, 2)) for _ in range(200)]
    got = M.mcc(spark.createDataFrame(pairs, "gold int, pred int")).first().mcc
    gold, pred = np.eye(3)[[g for g, _ in pairs]], np.eye(3)[[p for _, p in pairs]]
    cov = lambda x, y: sum(np.cov(x[:, k], y[:, k])[0, 1] for k in range(3))
    assert math.isclose(got, cov(gold, pred) / math.sqrt(cov(gold, gold) * cov(pred, pred)), abs_tol=1e-12)


def test_scores_of_a_class_never_predicted(spark):
    rows = M.classification_report(spark.createDataFrame([(0, 0), (1, 0)], "gold int, pred int")).collect()
    by = {r.label: r for r in rows}
    assert (by["1"].precision, by["1"].recall, by["1"].f1, by["accuracy"].f1) == (0.0, 0.0, 0.0, 0.5)


def test_texts_of_bucket_histograms_are_not_shuffled(spark):
    """Counts leave a row by bucket, not by token, and pairs are not gathered in an array."""
    docs = spark.createDataFrame([(i, i % 2, "a a b c" + " d" * (i % 5)) for i in range(60)], "id int, label int, text string")
    buckets = settle(spark.createDataFrame([("a", 1, 120), ("b", 2, 60), ("c", 2, 60), ("d", 3, 120)], "token string, bucket int, freq int"))
    hist = X.bucket_histogram(docs, "id", ["label"], V.field_tokens("text"), buckets)
    plan = hist._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and plan.count("Aggregate") == 2
    got = {(r.id, r.label): [tuple(x) for x in r.hist] for r in hist.collect()}
    assert got == {(i, i % 2): [(1, 2), (2, 2)] + [(3, i % 5)] * (i % 5 > 0) for i in range(60)}
    pairs = X.ordered_pairs(hist, ["label"]).groupBy("label", "b1", "b2").agg(F.sum("n").alias("n")).collect()
    want = {}
    for (_, label), row in got.items():
        for b1, x in row:
            for b2, y in row:
                want[label, b1, b2] = want.get((label, b1, b2), 0) + x * y
    assert {(r.label, r.b1, r.b2): r.n for r in pairs} == want


def test_token_counts_equal_both_frequencies(spark):
    texts = ["a b a, c!", "", None, "None", "b b b", "É e 日本 a", "  ", "a"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    got = V.token_counts(df, "text")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # texts are tokenised once
    rows = {r.token: (r.terms, r.docs) for r in got.collect()}
    terms, docs = ({r.token: r.freq for r in t.collect()} for t in (V.term_freq(df, "text"), V.doc_freq(df, ["text"])))
    assert rows == {t: (terms[t], docs[t]) for t in terms} and terms.keys() == docs.keys()


def test_probe_rows_count_the_tokens_once(spark, monkeypatch):
    """The table that the corpus meets has the frequencies by which its words are told common or rare."""
    from wordmill.operators import assoc

    met = []
    monkeypatch.setattr(assoc, "join_by_token", lambda rows, table: met.append(table) or rows.join(table, "token"))
    words = spark.createDataFrame([(1, "train", "a"), (2, "train", "a"), (3, "test", "a"), (3, "test", "b"), (3, "test", "c")], "id int, part string, token string")
    mapping = spark.createDataFrame([("x", "a"), ("y", "b"), ("z", "d")], "src string, dst string")
    control = spark.createDataFrame([("a", "y"), ("b", "y"), ("d", "x")], "dst string, label string")
    got = {tuple(r) for r in assoc.probe_rows(words, ["id"], "token", "part", mapping, control).collect()}
    assert {(r.token, r.freq) for r in met[0].collect()} == {("a", 3), ("b", 1), ("d", 0)}
    kinds = {(1, "train"), (2, "train"), (3, "test")}
    assert got == {(i, p, "a", k, v) for i, p in kinds for k, v in (("word", "x"), ("control", "y"))} | {(3, "test", "b", "control", "y")}
