"""Rank correlation, run names and classifiers."""

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wordmill.operators import metrics as M
from wordmill.operators import models, runs
from wordmill.operators import scale


def test_rank_correlation_with_ties(spark):
    rng = random.Random(8)
    rows = [(i, 1.0 if rng.random() < 0.8 else rng.random(), float(rng.randint(0, 9))) for i in range(500)]
    got = M.spearman(spark.createDataFrame([*rows, (500, None, 1.0)], "id int, g double, p double"), "g", "p").first().spearmanr
    df = pd.DataFrame(rows)
    assert abs(got - df[1].rank().corr(df[2].rank())) < 1e-12


def test_rank_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "g double, p double")
    assert M.spearman(df, "g", "p").first().spearmanr is None


def test_ranks_with_a_large_table_of_values(spark, monkeypatch):
    monkeypatch.setattr(scale, "is_small", lambda *_: False)
    rows = [(float(i % 7 if i % 5 else 3), float(i * 31 % 97)) for i in range(400)]
    df = pd.DataFrame(rows)
    got = M.spearman(spark.createDataFrame(rows, "g double, p double"), "g", "p").first().spearmanr
    assert abs(got - df[0].rank().corr(df[1].rank())) < 1e-12


def test_span_report_of_empty_rows(spark):
    rows = {r.type: r for r in M.span_report(spark.createDataFrame([([], [])], "g array<string>, p array<string>"), "g", "p").collect()}
    assert set(rows) == {"overall"} and rows["overall"].support == 0 and rows["overall"].f1 == 0


def test_perturbed_type(spark):
    names = {
        "m_data_wiki-15M-en~fr-x_seed_1": "en~fr-x",
        "m_data_wiki-15M_seed_1": "",
        "m_seed_1": "",
        "data_a-b-c_x_data_d-e-f_y": "f",
        "data_a-b-c_x_data_d-e_y": "c",
        "m_mydata_a-b-c": "",
    }
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r["name"]: r.perturbed_type for r in runs.parse_run_names(df, "name").collect()} == names


def test_missing_runs_lists_a_record_once(spark):
    paths = ["../m/1-1_task_a_x", "../m/2-1_task_a_x", "../m/1-1_task_b_x", "../m/1-1_task_c_x"]
    done = spark.createDataFrame([("1_2_3_4_task_b_x",)], "name string")
    got = runs.missing_runs(spark.createDataFrame([(p,) for p in paths], "path string"), "path", done, "name")
    assert {tuple(r) for r in got.collect()} == {("task_a_x", paths[1]), ("task_c_x", paths[3])}


def separable(spark, size):
    """The label is the feature that is set; every tenth row has none."""
    return models.feature_vectors(*plain_features(spark), "id", "label", size)


def plain_features(spark):
    rows = [(i, i % 2) for i in range(200)]
    features = [(i, label + 2 * (i % 3), 1 + i % 4) for i, label in rows if i % 10 > 1]
    return spark.createDataFrame(features, "id int, idx int, cnt int"), spark.createDataFrame(rows, "id int, label int")


def test_feature_vectors(spark):
    data = separable(spark, 6)
    by = {r.id: r.features for r in data.collect()}
    assert by[0].toArray().sum() == 0 and by[0].size == 6
    assert dict(zip(by[5].indices, by[5].values)) == {1 + 2 * 2: 2.0}


def test_classifiers_separate(spark):
    features, rows = plain_features(spark)
    train = models.examples(features, rows.where("id % 10 > 1"), "id", "label")
    scores = models.bow_classifier(train, {"same": train}, (2, 8)).first()
    assert scores.best_macro_f1 == 1.0 and abs(scores.best_mcc - 1) < 1e-12
    data = separable(spark, 6)
    seen = data.where(F.col("id") % 10 > 1)
    scores = models.mlp(seen, {"same": seen}, [6, 8, 2], steps=60).first()
    assert scores.macro_f1 == 1.0 and abs(scores.mcc - 1) < 1e-12


def plain_loss(x, y, w, l2):
    """Loss of the linear model with one row of coefficients per feature, and its gradient."""
    scores = x @ w
    p = np.exp(scores - scores.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    told = np.eye(w.shape[1])[y]
    return -np.log((p * told).sum(1)).mean() + l2 / 2 * (w**2).sum(), x.T @ (p - told) / len(x) + l2 * w


@pytest.mark.parametrize("broadcast", [True, False])
def test_linear_model_finds_the_least_loss(spark, monkeypatch, broadcast):
    """Three classes over features of which one is in most rows: the loss falls and the gradient vanishes, with and without a broadcast."""
    monkeypatch.setattr(scale, "is_small", lambda df, limit=0: broadcast)
    rng = np.random.default_rng(4)
    n, size, l2 = 120, 6, 0.05
    counts = rng.poisson(0.7, (n, size)) * (rng.random((n, size)) < 0.6)
    counts[5:, 0] += 1
    y = (counts[:, 1] + 2 * counts[:, 2] + rng.integers(0, 2, n)) % 3
    cells = [(i, j, int(counts[i, j])) for i in range(n) for j in range(size) if counts[i, j]]
    features = spark.createDataFrame(cells, "id int, idx int, cnt int")
    rows = spark.createDataFrame([*enumerate(y.tolist()), (n, None), (None, 1)], "id int, label int")
    train = models.examples(features, rows, "id", "label")
    x = np.c_[np.ones(n), counts]
    losses, slopes = [], []
    for coefs in models.linear_steps(train, 30 if broadcast else 4, l2):
        w = np.zeros((size + 1, 3))
        for r in coefs.collect():
            w[r["idx"] + 1] = r["w0"], r["w1"], r["w2"]
        loss, slope = plain_loss(x, y, w, l2)
        losses.append(loss)
        slopes.append(np.abs(slope).max())
    first, _ = plain_loss(x, y, np.zeros((size + 1, 3)), l2)
    assert losses[0] < first and losses[3] < losses[0]
    if broadcast:
        assert slopes[-1] < 0.02 * np.abs(plain_loss(x, y, np.zeros((size + 1, 3)), l2)[1]).max()
    guesses = {r["row"]: (r["gold"], r["pred"]) for r in models.linear_guesses(train, coefs).collect()}
    assert guesses == {i: (int(y[i]), int((x[i] @ w).argmax())) for i in range(n)}


def test_linear_model_without_rows(spark):
    features, rows = plain_features(spark)
    none = models.examples(features, rows.limit(0), "id", "label")
    [coefs] = models.linear_steps(none, 1)
    assert coefs.count() == 0
    every = models.linear_guesses(models.examples(features, rows, "id", "label"), coefs)
    assert {r["pred"] for r in every.collect()} == {0} and every.count() == 200


def test_network_scores_equal_sql(spark):
    """The forward pass of a fitted network, in SQL over its exported weights, gives the same classes."""
    data = separable(spark, 6)
    layers = [6, 5, 2]
    model = models.network(data, layers, steps=15, seed=1)
    got = {r["id"]: int(r["prediction"]) for r in model.transform(data).collect()}
    con = duckdb.connect()
    x = pd.DataFrame([(r.id, j, v) for r in data.collect() for j, v in enumerate(r.features.toArray().tolist())], columns=["id", "j", "v"])  # noqa: F841
    at, weights = 0, []
    for layer, (a, b) in enumerate(zip(layers, layers[1:])):
        flat = model.weights.toArray()[at : at + (a + 1) * b]
        weights += [(layer, j, k, flat[j * b + k]) for j in range(a + 1) for k in range(b)]
        at += (a + 1) * b
    w = pd.DataFrame(weights, columns=["layer", "j", "k", "w"])  # noqa: F841
    sql = """
        WITH inputs AS (SELECT id, j, v FROM x UNION ALL SELECT DISTINCT id, 6, 1.0 FROM x),
        hidden AS (SELECT id, k AS j, 1 / (1 + exp(-sum(v * w))) AS v FROM inputs JOIN w USING (j) WHERE layer = 0 GROUP BY ALL),
        second AS (SELECT * FROM hidden UNION ALL SELECT DISTINCT id, 5, 1.0 FROM hidden),
        scores AS (SELECT id, k, sum(v * w) AS score FROM second JOIN w USING (j) WHERE layer = 1 GROUP BY ALL)
        SELECT id, arg_max(k, score) FROM scores GROUP BY id"""
    assert dict(con.execute(sql).fetchall()) == got and set(got.values()) == {0, 1}


def test_random_guesses_have_a_digest_each(spark):
    """Every row and run draws by a digest of its own, whose first 32 bits are the uniform number."""
    rows = [(i, "aab"[i % 3]) for i in range(30)]
    got = {(r.run, r.gold, r.pred): r.n for r in M.random_confusion(spark.createDataFrame(rows, "id int, label string"), "id", "label", 9, 5).collect()}
    want = {}
    for run in range(1, 10):
        for i, gold in rows:
            u = int(hashlib.md5(f"5|{run}|{i}".encode()).hexdigest()[:8], 16) / 2**32
            at = (run, gold, "a" if u < 2 / 3 else "b")
            want[at] = want.get(at, 0) + 1
    assert got == want


def test_span_report_equals_spans_of_each_row(spark):
    """Rows of uneven length, many types, and null rows, against the spans that the column expression finds."""
    rng = random.Random(3)
    tag = lambda: rng.choice(["O", "O", "B-A", "I-A", "I-B", "B-B", "B-", "X"])
    rows = [([tag() for _ in range(n)], [tag() for _ in range(n + rng.choice([0, 0, 0, 1, -1]))]) for n in [0, 1, 1, 2, *range(1, 60)]]
    rows += [(x, list(x)) for x, _ in rows[:20]] + [(None, ["B-A"]), (["B-A"], None)]
    df = spark.createDataFrame(rows, "g array<string>, p array<string>")
    found = df.where("g IS NOT NULL AND p IS NOT NULL").select(M.spans(F.col("g")).alias("g"), M.spans(F.col("p")).alias("p")).collect()
    gold, pred = ({(i, *s) for i, r in enumerate(found) for s in r[c]} for c in "gp")
    got = {r.type: r for r in M.span_report(df, "g", "p").collect()}
    assert set(got) == {s[1] for s in gold | pred} | {"overall"}
    for kind, r in got.items():
        mine = [{s for s in side if kind in ("overall", s[1])} for side in (gold, pred, gold & pred)]
        assert (r.support, round(r.precision, 9), round(r.recall, 9)) == (len(mine[0]), round(len(mine[2]) / max(1, len(mine[1])), 9), round(len(mine[2]) / max(1, len(mine[0])), 9))
    same = sum(a == b for g, p in rows if g is not None and p is not None for a, b in zip(g, p))
    assert abs(got["overall"].accuracy - same / sum(len(g) for g, p in rows if g is not None and p is not None)) < 1e-12


def test_span_report_passes_tags_in_batches(spark):
    """Spans are found on whole batches, not position by position in nested expressions."""
    df = spark.createDataFrame([(["B-A"], ["O"])], "g array<string>, p array<string>")
    with_names = []
    real = M.settle
    M.settle = lambda t, *a: with_names.append(t) or real(t, *a)
    try:
        M.span_report(df, "g", "p")
    finally:
        M.settle = real
    assert "MapInArrow" in with_names[0]._jdf.queryExecution().optimizedPlan().toString()


def test_linear_steps_leave_the_rows_in_their_blocks(spark, monkeypatch):
    data = spark.createDataFrame(
        [(r, r % 3, [(-1, 1.0), (r % 4, 1.0 + r % 2), (100 + r, 1.0)]) for r in range(12)], "row long, label int, f array<struct<idx:bigint,x:double>>"
    )
    found = []
    monkeypatch.setattr(models, "margins", None)  # a pass joins no coefficients to the rows one by one
    for cells in (1, models.BLOCK_CELLS):
        monkeypatch.setattr(models, "BLOCK_CELLS", cells)
        *_, last = models.linear_steps(data, 3)
        found.append({r.idx: [r.freq, r.w0, r.w1, r.w2] for r in last.collect()})
    assert len(found[0]) == 17 and found[0].keys() == found[1].keys()
    assert all(found[0][i] == pytest.approx(found[1][i]) for i in found[0]) and any(abs(r[1]) > 1e-3 for r in found[0].values())
