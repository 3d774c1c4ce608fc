"""Queries over metrics, baselines, classifiers and run bookkeeping."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wordmill.functions.hashing import hash_unit
from wordmill.functions.text import argmax as best_position
from wordmill.operators import features as X
from wordmill.operators import metrics as M
from wordmill.operators import models
from wordmill.operators import rewrite as R
from wordmill.operators import runs
from wordmill.operators import swap as W
from wordmill.operators import vocab as V
from wordmill.operators.scale import settle
from wordmill.plans import inputs as I
from wordmill.plans import sql as S
from wordmill.plans.registry import query

LANGS = "langs AS (SELECT doc_id, lang AS gold, CASE WHEN n_chars % 4 = 0 THEN 'en' ELSE lang END AS pred FROM documents)"


def report(table: str, by: str = "") -> str:
    """Per-class scores of a table with gold and pred, optionally per group."""
    g = f"{by}, " if by else ""
    return f"""sides AS (
  SELECT {g}gold AS label, 1 AS s, 0 AS p, (gold = pred)::INT AS h FROM {table} UNION ALL SELECT {g}pred, 0, 1, 0 FROM {table}),
scores AS (
  SELECT {g}label, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hit,
         CASE WHEN sum(p) = 0 THEN 0 ELSE sum(h)::DOUBLE / sum(p) END AS precision,
         CASE WHEN sum(s) = 0 THEN 0 ELSE sum(h)::DOUBLE / sum(s) END AS recall, 2.0::DOUBLE * sum(h) / (sum(s) + sum(p)) AS f1
  FROM sides GROUP BY {g}label)"""


def mcc_sql(by: str = "") -> str:
    g = f"{by}, " if by else ""
    end = f" GROUP BY {by}" if by else ""
    return f"""mccs AS (
  SELECT {g}CASE WHEN (s * s - pp) * (s * s - tt) = 0 THEN 0 ELSE (c * s - pt) / (sqrt(s * s - pp) * sqrt(s * s - tt)) END AS mcc
  FROM (SELECT {g}sum(hit)::DOUBLE AS c, sum(support)::DOUBLE AS s, sum(predicted::DOUBLE * support) AS pt, sum(predicted::DOUBLE * predicted) AS pp,
               sum(support::DOUBLE * support) AS tt FROM scores{end}))"""


ROUNDED = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support"
REPORT = (
    f"SELECT label::VARCHAR AS label, {ROUNDED} FROM scores "
    "UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), t FROM (SELECT sum(hit)::DOUBLE / sum(support) AS a, sum(support)::BIGINT AS t FROM scores) "
    "UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM scores "
    "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), "
    "round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM scores"
)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(S.with_(LANGS, report("langs")) + REPORT)
def classification_report(spark, folder):
    return rounded(M.classification_report(I.languages(spark, folder)), "precision", "recall", "f1")


@query(S.with_(LANGS, report("langs"), mcc_sql()) + "SELECT round(mcc, 6) AS mcc FROM mccs")
def mcc(spark, folder):
    return rounded(M.mcc(I.languages(spark, folder)), "mcc")


BINARY = "binary_rows AS (SELECT doc_id, quality AS gold, pred FROM labelled)"


def _binary(spark, folder):
    return I.labelled(spark, folder).select("doc_id", F.col("quality").alias("gold"), "pred")


def _task_sql(*metrics: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS metric, {value} AS value FROM {source}" for name, value, source in metrics)


ACCURACY = ("accuracy", "sum(hit)::DOUBLE / sum(support)", "scores")
F1 = ("f1", "coalesce(max(f1) FILTER (label = 1), 0)", "scores")


@query(
    S.with_(S.LABELLED, BINARY, report("binary_rows"), f"m AS ({_task_sql(ACCURACY, F1)})")
    + "SELECT metric, round(value, 6) AS value FROM m UNION ALL SELECT 'combined_score', round(avg(value), 6) FROM m"
)
def task_metrics_accuracy_f1(spark, folder):
    return rounded(M.task_metrics(_binary(spark, folder), "mrpc", "doc_id"), "value")


@query(S.with_(S.LABELLED, BINARY, report("binary_rows"), mcc_sql()) + "SELECT 'matthews_correlation' AS metric, round(mcc, 6) AS value FROM mccs")
def task_metrics_matthews(spark, folder):
    return rounded(M.task_metrics(_binary(spark, folder), "cola", "doc_id"), "value")


NUMBERS = "numbers AS (SELECT doc_id, n_chars::DOUBLE AS gold, (n_chars % 50 + doc_id % 13)::DOUBLE AS pred FROM documents)"


def _numbers(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs.select(
        "doc_id",
        F.col("n_chars").cast("double").alias("gold"),
        (F.col("n_chars") % 50 + F.col("doc_id") % 13).cast("double").alias("pred"),
    )


AVERAGE_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


@query(
    S.with_(
        NUMBERS,
        f"ranked AS (SELECT *, {AVERAGE_RANK.format(c='gold')} AS rg, {AVERAGE_RANK.format(c='pred')} AS rp FROM numbers)",
        "m AS (SELECT 'pearson' AS metric, corr(gold, pred) AS value FROM ranked UNION ALL SELECT 'spearmanr', corr(rg, rp) FROM ranked)",
    )
    + "SELECT metric, round(value, 6) AS value FROM m UNION ALL SELECT 'combined_score', round(avg(value), 6) FROM m"
)
def task_metrics_correlation(spark, folder):
    return rounded(M.task_metrics(_numbers(spark, folder), "stsb", "doc_id"), "value")


@query(S.with_(NUMBERS) + "SELECT round(avg((pred - gold) * (pred - gold)), 4) AS mse FROM numbers")
def mean_squared_error(spark, folder):
    return M.mean_squared_error(_numbers(spark, folder)).withColumn("mse", F.round("mse", 4))


# Tags of the stand-in tagging task: digits form NUM spans, punctuation PUN spans, the rest is outside;
# predictions miss tokens whose length is divisible by 5 and see short words as NUM.
TAG_SQL = {
    "gold_tag": r"CASE WHEN regexp_full_match(token, '[0-9]+') THEN 'B-NUM' WHEN regexp_full_match(token, '[[:punct:]]') THEN 'I-PUN' ELSE 'O' END",
    "pred_tag": r"CASE WHEN length(token) % 5 = 0 THEN 'O' WHEN regexp_full_match(token, '[0-9]+') THEN 'I-NUM' WHEN regexp_full_match(token, '[[:punct:]]') THEN 'I-PUN' "
    r"WHEN length(token) = 1 THEN 'B-NUM' ELSE 'O' END",
}


def _tagged(spark, folder):
    number, sign = (lambda t: t.rlike("^[0-9]+$")), (lambda t: t.rlike(r"^[!-/:-@\[-`{-~]$"))
    letter = lambda t: F.ascii(t).between(97, 122)  # such tokens, nearly all, need no pattern
    gold = lambda t: F.when(letter(t), "O").when(number(t), "B-NUM").when(sign(t), "I-PUN").otherwise("O")
    pred = lambda t: (
        F.when(F.length(t) % 5 == 0, "O")
        .when(letter(t) & (F.length(t) > 1), "O")
        .when(number(t), "I-NUM")
        .when(sign(t), "I-PUN")
        .when(F.length(t) == 1, "B-NUM")
        .otherwise("O")
    )
    docs = I.documents(spark, folder).select("doc_id", I.tokens().alias("tokens"))
    return docs.select("doc_id", F.transform("tokens", gold).alias("gold"), F.transform("tokens", pred).alias("pred"))


TAGGED = (S.DOC_TOKENS, S.DOC_ROWS, f"tagged AS (SELECT doc_id, pos, {TAG_SQL['gold_tag']} AS gold, {TAG_SQL['pred_tag']} AS pred FROM doc_rows)")


@query(
    S.with_(*TAGGED, report("(SELECT gold, pred FROM tagged WHERE gold <> 'O')"))
    + "SELECT round(avg(f1), 6) AS f1, round(sum(hit)::DOUBLE / sum(support), 6) AS accuracy FROM scores"
)
def token_report(spark, folder):
    """Macro scores over the tagged positions; positions outside are the ignored ones here."""
    return rounded(M.token_report(_tagged(spark, folder), "gold", "pred", ignore="O"), "f1", "accuracy")


def span_sql(col: str) -> str:
    kind = f"CASE WHEN {col} = 'O' THEN '' ELSE substr({col}, 3) END"
    return f"""{col}_l AS (
  SELECT doc_id, pos, {col} AS tag, {kind} AS kind, lag({col}, 1, 'O') OVER w AS prev, lag({kind}, 1, '') OVER w AS prev_kind FROM tagged WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
{col}_s AS (SELECT *, sum(CASE WHEN tag <> 'O' AND (starts_with(tag, 'B-') OR prev = 'O' OR prev_kind <> kind) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM {col}_l),
{col}_spans AS (SELECT doc_id, kind AS type, min(pos) AS a, max(pos) AS b FROM {col}_s WHERE tag <> 'O' GROUP BY doc_id, span, kind)"""


@query(
    S.with_(
        *TAGGED,
        span_sql("gold"),
        span_sql("pred"),
        """counts AS (
  SELECT type, count(*) FILTER (g) AS support, count(*) FILTER (p) AS predicted, count(*) FILTER (g AND p) AS hit
  FROM (SELECT coalesce(x.type, y.type) AS type, x.type IS NOT NULL AS g, y.type IS NOT NULL AS p
        FROM gold_spans x FULL JOIN pred_spans y ON x.doc_id = y.doc_id AND x.type = y.type AND x.a = y.a AND x.b = y.b) GROUP BY type)""",
        "everything AS (SELECT * FROM counts UNION ALL SELECT 'overall', sum(support)::BIGINT, sum(predicted)::BIGINT, sum(hit)::BIGINT FROM counts)",
    )
    + "SELECT type, round(CASE WHEN predicted = 0 THEN 0 ELSE hit::DOUBLE / predicted END, 6) AS precision, round(CASE WHEN support = 0 THEN 0 ELSE hit::DOUBLE / support END, 6) AS recall, "
    + "round(2.0::DOUBLE * hit / (support + predicted), 6) AS f1, support, "
    + "CASE WHEN type = 'overall' THEN (SELECT round(avg((gold = pred)::INT), 6) FROM tagged) END AS accuracy FROM everything"
)
def span_report(spark, folder):
    return rounded(M.span_report(_tagged(spark, folder), "gold", "pred"), "precision", "recall", "f1", "accuracy")


@query(S.with_(*TAGGED, report("tagged")) + "SELECT round(2.0::DOUBLE * sum(hit) / (sum(support) + sum(predicted)), 6) AS f1 FROM scores WHERE label IN ('B-NUM', 'I-NUM', 'I-PUN')")
def flat_f1(spark, folder):
    return rounded(M.flat_f1(_tagged(spark, folder), "gold", "pred", ["B-NUM", "I-NUM", "I-PUN"]), "f1")


DRAW = "list_filter(items, lambda i: i.upto > u)"


@query(
    S.with_(
        "priors AS (SELECT list({'label': lang, 'upto': c / t} ORDER BY lang) AS items FROM (SELECT lang, sum(count(*)) OVER (ORDER BY lang) AS c, sum(count(*)) OVER ()::DOUBLE AS t FROM documents GROUP BY lang))",
        f"draws AS (SELECT run, lang AS gold, {S.unit(42, 'run', 'doc_id')} AS u FROM documents, range(1, 101) r(run))",
        f"guesses AS (SELECT run, gold, ({DRAW})[1].label AS pred FROM draws, priors)",
        report("guesses", "run"),
        mcc_sql("run"),
        "f1s AS (SELECT run, avg(f1) AS f1 FROM scores GROUP BY run)",
    )
    + "SELECT count(*) AS runs, round(avg(f1), 6) AS mean_f1, round(stddev_samp(f1), 6) AS std_f1, round(avg(mcc), 6) AS mean_mcc FROM f1s JOIN mccs USING (run)"
)
def random_baseline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    return rounded(M.random_baseline(docs, "doc_id", "lang"), "mean_f1", "std_f1", "mean_mcc")


@query(
    S.with_(
        *TAGGED,
        "priors AS (SELECT list({'label': gold, 'upto': c / t} ORDER BY gold) AS items FROM (SELECT gold, sum(count(*)) OVER (ORDER BY gold) AS c, sum(count(*)) OVER ()::DOUBLE AS t FROM tagged GROUP BY gold))",
        f"guesses AS (SELECT gold, ({DRAW})[1].label AS pred FROM (SELECT gold, {S.unit(42, 'doc_id', 'pos')} AS u FROM tagged), priors)",
        report("guesses"),
    )
    + REPORT
)
def random_baseline_tags(spark, folder):
    guessed = M.random_tags(_tagged(spark, folder).select("doc_id", "gold"), "doc_id", "gold", I.SEED)
    flat = M.flat_tags(guessed, "gold", "pred_tags")
    return rounded(M.classification_report(flat), "precision", "recall", "f1")


@query("SELECT round(exp(avg(n_chars % 7)), 6) AS perplexity FROM documents")
def perplexity(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return rounded(M.perplexity(docs.withColumn("loss", F.col("n_chars") % 7), "loss"), "perplexity")


SCORES = "[n_chars % 7, doc_id % 5, n_chars % 3]"


def _scored(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scores = F.array(F.col("n_chars") % 7, F.col("doc_id") % 5, F.col("n_chars") % 3)
    return docs.select("doc_id", best_position(scores).alias("pred"), (F.col("doc_id") % 3).cast("int").alias("gold"))


@query(f"SELECT doc_id, (list_position({SCORES}, list_max({SCORES})) - 1)::INT AS pred FROM documents")
def argmax(spark, folder):
    return _scored(spark, folder).select("doc_id", "pred")


@query(f"SELECT round(avg((list_position({SCORES}, list_max({SCORES})) - 1 = doc_id % 3)::INT) * 100, 6) AS exact_match FROM documents")
def exact_match(spark, folder):
    return rounded(M.exact_match(_scored(spark, folder)), "exact_match")


def _linear_sql(lengths: tuple[int, ...], l2: float) -> list[str]:
    """The linear model in plain steps: coefficients c<i> after i passes over ``train_cells``, then guesses for ``eval_cells``."""
    parts = [
        "sizes AS (SELECT doc_id, sum(x) AS size FROM train_cells GROUP BY doc_id)",
        "n AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM train_cells)",
        f"c0 AS MATERIALIZED (SELECT token, sum(x * size) / (2 * (SELECT n FROM n)) + {l2}::DOUBLE AS rate, "
        "0::DOUBLE AS w0, 0::DOUBLE AS w1, 0::DOUBLE AS v0, 0::DOUBLE AS v1 FROM train_cells JOIN sizes USING (doc_id) GROUP BY token)",
    ]
    pace = 1.0
    for i in range(1, max(lengths) + 1):
        following = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        momentum, pace = (pace - 1) / following, following
        step = "c.v{k} - (g{k} / (SELECT n FROM n) + " + f"{l2}::DOUBLE * c.v{{k}}) / c.rate AS n{{k}}"
        parts += [
            f"m{i} AS MATERIALIZED (SELECT doc_id, label, 1 / (1 + exp(sum(x * v1) - sum(x * v0))) AS p0 FROM train_cells JOIN c{i - 1} USING (token) GROUP BY ALL)",
            f"g{i} AS (SELECT token, sum(x * (p0 - (label = 0)::INT)) AS g0, sum(x * (1 - p0 - (label = 1)::INT)) AS g1 "
            f"FROM train_cells JOIN m{i} USING (doc_id, label) GROUP BY token)",
            f"c{i} AS MATERIALIZED (SELECT token, rate, n0 AS w0, n1 AS w1, n0 + {momentum!r}::DOUBLE * (n0 - w0) AS v0, n1 + {momentum!r}::DOUBLE * (n1 - w1) AS v1 "
            f"FROM (SELECT c.token, c.rate, c.w0, c.w1, {step.format(k=0)}, {step.format(k=1)} FROM c{i - 1} c JOIN g{i} USING (token)))",
        ]
    guesses = " UNION ALL ".join(
        f"SELECT {i} AS steps, kind, doc_id, label AS gold, (coalesce(sum(x * w1), 0) > coalesce(sum(x * w0), 0))::INT AS pred "
        f"FROM eval_cells LEFT JOIN c{i} USING (token) GROUP BY kind, doc_id, label"
        for i in lengths
    )
    return [*parts, f"guesses AS MATERIALIZED ({guesses})"]


def _cells_sql(source: str, keys: str) -> str:
    """Counted words of every row, and the intercept as the empty word."""
    return f"SELECT {keys}, token, count(*)::DOUBLE AS x FROM {source} WHERE token IS NOT NULL GROUP BY {keys}, token UNION ALL SELECT DISTINCT {keys}, '', 1::DOUBLE FROM {source}"


@query(
    S.with_(
        S.LABELLED,
        f"told AS MATERIALIZED (SELECT doc_id, quality AS label, doc_id % 10 > 1 AS train, {S.tok('text')} AS toks FROM labelled WHERE quality IS NOT NULL)",
        "tf AS MATERIALIZED (SELECT token, count(*) AS freq FROM (SELECT unnest(toks) AS token FROM told) GROUP BY token)",
        "vocab AS (SELECT token, freq, 1 AS n_pieces FROM tf)",
        S.swap_rank("vocab"),
        S.permuted("tf", "freq DESC, md5(token)"),
        "words AS MATERIALIZED (SELECT doc_id, label, train, unnest(CASE WHEN coalesce(len(toks), 0) = 0 THEN [NULL] ELSE toks END) AS token FROM told)",
        "held AS MATERIALIZED (SELECT * FROM words WHERE NOT train)",
        "evals AS (SELECT 'original' AS kind, doc_id, label, token FROM held "
        "UNION ALL SELECT 'matched', doc_id, label, coalesce(dst, token) FROM held LEFT JOIN swaps ON src = token "
        "UNION ALL SELECT 'blind', doc_id, label, b.token FROM held h LEFT JOIN a ON a.token = h.token LEFT JOIN b USING (spot))",
        f"train_cells AS MATERIALIZED ({_cells_sql('(SELECT * FROM words WHERE train)', 'doc_id, label')})",
        f"eval_cells AS MATERIALIZED ({_cells_sql('evals', 'kind, doc_id, label')})",
        *_linear_sql((5, 20), models.L2),
        report("guesses", "steps, kind"),
        mcc_sql("steps, kind"),
        "f AS (SELECT steps, kind, avg(f1) AS f1 FROM scores GROUP BY ALL)",
    )
    + 'SELECT kind AS "set", round(max(f1), 6) AS best_macro_f1, round(max(mcc), 6) AS best_mcc FROM f JOIN mccs USING (steps, kind) GROUP BY kind'
)
def bow_classifier(spark, folder):
    """Trained on the labelled documents, scored on the originals and on two rewrites."""
    docs = settle(I.labelled(spark, folder).select("doc_id", "text", "quality", I.split_column().alias("split")), "labelled")
    vocab = settle(V.term_freq(docs, "text").withColumn("n_pieces", F.lit(1)), "vocab")
    index = settle(
        V.vocab_index(docs.withColumn("o", F.when(F.col("split") == "train", 0).otherwise(1)), "o", "doc_id", ["text"]), "index"
    )

    def examples(rows):
        return models.examples(X.bow(rows, "doc_id", ["text"], index), rows, "doc_id", "quality")

    held_out = docs.where("split <> 'train'")
    matched = R.apply_swap(held_out, "doc_id", ["text"], settle(W.weighed(W.swap_rank(vocab), vocab), "map"))
    blind = R.apply_swap(held_out, "doc_id", ["text"], settle(W.weighed(W.swap_random(vocab, I.SEED), vocab), "map"))
    evals = {name: examples(rows) for name, rows in {"original": held_out, "matched": matched, "blind": blind}.items()}
    return rounded(models.bow_classifier(examples(docs.where("split = 'train'")), evals), "best_macro_f1", "best_mcc")


@query()
def bow_mlp(spark, folder):
    """Two-layer classifier on frequency-bucket features of the labelled documents."""
    docs = settle(I.labelled(spark, folder).select("doc_id", "text", "quality", I.split_column().alias("split")), "labelled")
    buckets = settle(V.bucketize(settle(V.term_freq(docs, "text"), "freq"), 25), "buckets")

    def vectors(rows):
        features = X.bucket_bow(rows, "doc_id", "text", buckets)
        return models.feature_vectors(features, rows, "doc_id", "quality", 25)

    evals = {"original": vectors(docs.where("split <> 'train'"))}
    return models.mlp(vectors(docs.where("split = 'train'")), evals, [25, 32, 2])


@query()
def probe_mlp(spark, folder):
    """Three-layer probe from embedding rows to their labels."""
    emb = spark.read.parquet(f"{folder}/embeddings.parquet")
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    rows = settle(
        emb.select(
            "vec_id",
            F.col("label").cast("double").alias("label"),
            array_to_vector(doubles).alias("features"),
            (hash_unit(I.SEED, "vec_id") < 0.9).alias("train"),
        ),
        "probe",
    )
    classes = int(rows.agg(F.max("label")).first()[0]) + 1
    size = emb.select(F.max(F.size("embedding"))).first()[0]
    return models.mlp(rows.where("train"), {"dev": rows.where(~F.col("train"))}, [size, 64, 32, classes])


MODELS = ["bert-base-uncased", "bert-base-cased", "albert-base-v2", "bert-base-dutch-cased", "flaubert_base_cased", "deberta-base", "gpt"]
TASKS = ["cola", "mrpc", "sst2", "qnli", "rte", "wnli", "stsb"]
DATA = ["data_wikitext-15M_", "data_wikitext-15M-en~fr@N~fr@V_", "data_wikitext-15M-en~fr@N~jaktc@V_"]
RATES = ["lr_2e-05", "lr_4e-05", "lr_6e-05", "lr_8e-05", "lr_1e-03"]


def _run_name_sql() -> str:
    pick = lambda items, by: "['" + "', '".join(items) + f"'][{by} + 1]"
    flag = lambda by: f"(CASE WHEN {by} = 0 THEN 'True' ELSE 'False' END)"
    return (
        "'../models/' || (doc_id % 12 + 1) || '-' || (n_chars % 28 + 1) || '_task_' || "
        + pick(TASKS, "doc_id % 7")
        + " || '_ft_' || "
        + pick(MODELS, "n_chars % 7")
        + " || '_' || "
        + pick(DATA, "n_chars % 3")
        + " || 'inoculation_' || (CASE WHEN doc_id % 2 = 0 THEN '1.0' ELSE '0.0' END) || '_seed_' || (doc_id % 100) || '_reverse_' || "
        + flag("doc_id % 3")
        + " || '_random_' || "
        + flag("doc_id % 4")
        + " || '_token_s_' || "
        + flag("n_chars % 5")
        + " || '_word_s_' || "
        + flag("n_chars % 6")
        + " || '_reinit_emb_' || "
        + flag("n_chars % 2")
        + " || '_' || "
        + pick(RATES, "n_chars % 5")
    )


def _run_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "n_chars", "lang")
    pick = lambda items, by: F.element_at(F.array(*[F.lit(x) for x in items]), (by + 1).cast("int"))
    flag = lambda by: F.when(by == 0, "True").otherwise("False")
    d, n = F.col("doc_id"), F.col("n_chars")
    parts = [
        "../models/", d % 12 + 1, "-", n % 28 + 1, "_task_", pick(TASKS, d % 7), "_ft_", pick(MODELS, n % 7), "_", pick(DATA, n % 3),
        "inoculation_", F.when(d % 2 == 0, "1.0").otherwise("0.0"), "_seed_", d % 100, "_reverse_", flag(d % 3), "_random_", flag(d % 4),
        "_token_s_", flag(n % 5), "_word_s_", flag(n % 6), "_reinit_emb_", flag(n % 2), "_", pick(RATES, n % 5),
    ]
    return docs.withColumn("path", F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


NAMES = f"names AS (SELECT doc_id, n_chars, lang, {_run_name_sql()} AS path FROM documents)"
MODEL_SQL = (
    "CASE WHEN path LIKE '%albert-base-v2%' THEN 'albert-base-v2' WHEN path LIKE '%bert-base-cased%' THEN 'bert-base-cased' "
    "WHEN contains(path, 'flaubert_base_cased') THEN 'flaubert/flaubert_base_cased' WHEN contains(path, 'bert-base-dutch-cased') THEN 'GroNLP/bert-base-dutch-cased' "
    "WHEN contains(path, 'bert-base-uncased') THEN 'bert-base-uncased' WHEN contains(path, 'deberta-base') THEN 'microsoft/deberta-base' END"
)


@query(
    S.with_(NAMES, f"named AS (SELECT *, {MODEL_SQL} AS model FROM names)")
    + r"""SELECT doc_id, regexp_extract(path, '_task_([^_]*)', 1) AS task, coalesce(model, 'none') AS model,
  CASE WHEN contains(path, 'lr_4e-05') THEN 4e-05 WHEN contains(path, 'lr_2e-05') THEN 2e-05 WHEN contains(path, 'lr_6e-05') THEN 6e-05 WHEN contains(path, 'lr_8e-05') THEN 8e-05 ELSE 2e-05 END::DOUBLE AS learning_rate,
  regexp_extract(path, '_seed_([0-9]+)', 1)::INT AS seed, regexp_extract(path, '_inoculation_([0-9.]+)', 1)::DOUBLE AS inoculation,
  contains(path, 'inoculation_1.0') AS midtuning,
  CASE WHEN contains(path, 'data_wikitext-15M-en~fr@N~fr@V') THEN 'en~fr@N~fr@V' WHEN contains(path, 'data_wikitext-15M-en~fr@N~jaktc@V') THEN 'en~fr@N~jaktc@V' ELSE 'null' END AS galactic_shift,
  array_to_string(string_split(regexp_extract(path, '_data_([^_]*)', 1), '-')[3:], '-') AS perturbed_type,
  CASE WHEN model IS NULL THEN 'none' WHEN model IN ('bert-base-uncased', 'microsoft/deberta-base') THEN contains(path, 'reinit_emb_True')::VARCHAR ELSE 'true' END AS reinit_embedding,
  contains(path, 'reverse_True') AS reverse_order, contains(path, 'random_True') AS random_order, contains(path, 'token_s_True') AS token_swap,
  contains(path, 'word_s_True') AS word_swap, contains(path, 'word_freq_s_True') AS word_swap_frequency FROM named"""
)
def parse_run_names(spark, folder):
    parsed = runs.parse_run_names(_run_names(spark, folder), "path").drop("path", "n_chars", "lang")
    return parsed.withColumns(
        {
            "model": F.coalesce("model", F.lit("none")),
            "reinit_embedding": F.coalesce(F.col("reinit_embedding").cast("string"), F.lit("none")),
        }
    )


@query(
    S.with_(
        NAMES,
        "wanted AS (SELECT path, array_to_string(string_split(string_split(path, '/')[-1], '_')[2:], '_') AS record FROM names)",
        "finished AS (SELECT DISTINCT record FROM (SELECT array_to_string(string_split(string_split(path, '/')[-1], '_')[2:], '_') AS record, lang FROM names) WHERE lang = 'en')",
    )
    + "SELECT record, max(path) AS path FROM wanted WHERE record NOT IN (SELECT record FROM finished) GROUP BY record"
)
def missing_runs(spark, folder):
    names = _run_names(spark, folder)
    folder_name = F.element_at(F.split("path", "/"), -1)
    record = F.regexp_replace(folder_name, "^[^_]*_", "")
    done = names.where("lang = 'en'").select(F.concat(F.lit("12-1_task_x_ft_"), record).alias("name"))
    return runs.missing_runs(names, "path", done, "name")


@query(
    S.with_(NAMES)
    + "SELECT lang, doc_id % 2 AS condition, max(n_chars) AS best_score, max_by(path, (n_chars, md5(path))) AS best_run FROM names GROUP BY ALL"
)
def best_runs(spark, folder):
    names = _run_names(spark, folder).withColumn("condition", F.col("doc_id") % 2)
    return runs.best_runs(names, ["lang", "condition"], "n_chars", "path")
