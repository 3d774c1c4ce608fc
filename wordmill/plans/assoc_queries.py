"""Queries over bucket/label association, embedding proximity and score reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordmill.operators import assoc as A
from wordmill.operators import swap as W
from wordmill.operators.scale import settle
from wordmill.plans import inputs as I
from wordmill.plans import sql as S
from wordmill.plans.registry import query

BASE = (
    S.LABELLED,
    f"toks AS (SELECT doc_id, quality AS label, {S.tok('text')} AS ws FROM labelled)",
    "rows AS (SELECT doc_id, label, unnest(ws) AS token FROM toks)",
    "lf AS (SELECT token, count(*) AS freq FROM rows GROUP BY token)",
    S.buckets("lf", 25),
    "hits AS (SELECT doc_id, label, bucket, count(*) AS n FROM rows JOIN buckets USING (token) GROUP BY ALL)",
    "priors AS (SELECT quality AS label, count(*) AS size, count(*)::DOUBLE / (SELECT count(*) FROM labelled) AS prior FROM labelled GROUP BY 1)",
)
LIFT = (
    "cells AS (SELECT label, bucket, sum(n)::BIGINT AS n FROM hits GROUP BY ALL)",
    """lifts AS (
  SELECT label, bucket, n, (n::DOUBLE / t) / ((k::DOUBLE / t) * prior) AS lift
  FROM cells JOIN (SELECT bucket, sum(n)::BIGINT AS k FROM cells GROUP BY 1) USING (bucket) JOIN priors USING (label), (SELECT sum(n)::BIGINT AS t FROM cells))""",
)
COVER = "covers AS (SELECT label, bucket, count(*)::DOUBLE / any_value(size) AS coverage FROM hits JOIN priors USING (label) GROUP BY label, bucket)"
PAIR_HITS = "pair_hits AS (SELECT x.doc_id, x.label, x.bucket AS b1, y.bucket AS b2, x.n * y.n AS n FROM hits x JOIN hits y USING (doc_id))"
PAIR_CELLS = "pcells AS (SELECT label, b1, b2, sum(n)::BIGINT AS n FROM pair_hits GROUP BY ALL)"
PAIR_LIFT = """plifts AS (
  SELECT label, b1, b2, n, (n::DOUBLE / t) / ((k::DOUBLE / t) * prior) AS lift
  FROM pcells JOIN (SELECT b1, b2, sum(n)::BIGINT AS k FROM pcells GROUP BY 1, 2) USING (b1, b2) JOIN priors USING (label), (SELECT sum(n)::BIGINT AS t FROM pcells))"""
PAIR_COVER = "pcovers AS (SELECT label, b1, b2, count(*)::DOUBLE / any_value(size) AS coverage FROM pair_hits JOIN priors USING (label) GROUP BY label, b1, b2)"


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _docs(spark, folder):
    return I.labelled(spark, folder)


@query(S.with_(*BASE, *LIFT) + "SELECT label, bucket::INT AS bucket, n, round(lift, 6) AS lift, round(log2(lift), 6) AS log2_lift FROM lifts")
def bucket_lift(spark, folder):
    return rounded(A.bucket_lift(_docs(spark, folder), "quality", "text"), "lift", "log2_lift")


@query(S.with_(*BASE, COVER) + "SELECT label, bucket::INT AS bucket, round(coverage, 6) AS coverage FROM covers")
def bucket_coverage(spark, folder):
    return rounded(A.bucket_coverage(_docs(spark, folder), "doc_id", "quality", "text"), "coverage")


@query(S.with_(*BASE, PAIR_HITS, PAIR_CELLS, PAIR_LIFT) + "SELECT label, b1::INT AS b1, b2::INT AS b2, n, round(lift, 6) AS lift, round(log2(lift), 6) AS log2_lift FROM plifts")
def pair_lift(spark, folder):
    return rounded(A.pair_lift(_docs(spark, folder), "doc_id", "quality", "text"), "lift", "log2_lift")


@query(S.with_(*BASE, PAIR_HITS, PAIR_COVER) + "SELECT label, b1::INT AS b1, b2::INT AS b2, round(coverage, 6) AS coverage FROM pcovers")
def pair_coverage(spark, folder):
    return rounded(A.pair_coverage(_docs(spark, folder), "doc_id", "quality", "text"), "coverage")


@query(
    S.with_(*BASE, *LIFT, COVER)
    + "SELECT label, rank::INT AS rank, bucket::INT AS bucket, round(lift, 6) AS lift, round(coverage, 6) AS coverage FROM "
    + "(SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(lift, 9) DESC, bucket) AS rank FROM lifts) JOIN covers USING (label, bucket) WHERE rank <= 5"
)
def lift_topk(spark, folder):
    lift, cover = A.lift_and_coverage(_docs(spark, folder), "doc_id", "quality", "text")
    return rounded(A.lift_topk(lift, cover, ["bucket"], 5), "lift", "coverage")


@query(
    S.with_(*BASE, PAIR_HITS, PAIR_CELLS, PAIR_LIFT, PAIR_COVER)
    + "SELECT label, rank::INT AS rank, b1::INT AS b1, b2::INT AS b2, round(lift, 6) AS lift, round(coverage, 6) AS coverage FROM "
    + "(SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(lift, 9) DESC, b1, b2) AS rank FROM plifts) JOIN pcovers USING (label, b1, b2) "
    + "WHERE rank <= 10 AND rank % 2 = 1"
)
def pair_lift_topk(spark, folder):
    lift, cover = A.lift_and_coverage(_docs(spark, folder), "doc_id", "quality", "text", pairs=True)
    return rounded(A.lift_topk(lift, cover, ["b1", "b2"], 10, every=2), "lift", "coverage")


@query(
    S.with_(
        *BASE,
        "counts AS (SELECT doc_id, label, token, bucket, count(*) AS n FROM rows JOIN buckets USING (token) GROUP BY ALL)",
        "each AS (SELECT *, unnest(range(1, n + 1)) AS i FROM counts)",
        f"drawn AS (SELECT label, bucket, row_number() OVER (PARTITION BY label ORDER BY {S.key(42, 'doc_id', 'token', 'i')}, doc_id, token, i) AS place FROM each)",
        "quota AS (SELECT min(n) AS q FROM (SELECT label, count(*) AS n FROM each GROUP BY label))",
    )
    + "SELECT label, "
    + ", ".join(f"count(*) FILTER (bucket = {i}) AS bucket_{i}" for i in range(1, 5))
    + " FROM drawn, quota WHERE place <= q GROUP BY label"
)
def bucket_counts(spark, folder):
    return A.bucket_counts(_docs(spark, folder), "doc_id", "quality", "text", I.SEED)


MATRIX = """matrix AS (
  SELECT c.label, c.b1, c.b2, coalesce(c.n::DOUBLE / d.n, 0) AS ratio
  FROM pcells c LEFT JOIN pcells d ON d.label = c.label AND d.b1 = greatest(c.b1, c.b2) AND d.b2 = greatest(c.b1, c.b2))"""


def _matrix(spark, folder):
    return A.pair_matrix(A.pair_cells(_docs(spark, folder), "doc_id", "quality", "text"))


@query(S.with_(*BASE, PAIR_HITS, PAIR_CELLS, MATRIX) + "SELECT label, b1::INT AS b1, b2::INT AS b2, round(ratio, 6) AS ratio FROM matrix")
def pair_matrix(spark, folder):
    return rounded(_matrix(spark, folder), "ratio")


@query(
    S.with_(*BASE, PAIR_HITS, PAIR_CELLS, MATRIX)
    + "SELECT 0 AS l1, 1 AS l2, coalesce(x.b1, y.b1)::INT AS b1, coalesce(x.b2, y.b2)::INT AS b2, round(coalesce(x.ratio, 0) - coalesce(y.ratio, 0), 6) AS diff "
    + "FROM (SELECT * FROM matrix WHERE label = 0) x FULL JOIN (SELECT * FROM matrix WHERE label = 1) y ON x.b1 = y.b1 AND x.b2 = y.b2"
)
def matrix_diff(spark, folder):
    return rounded(A.matrix_diff(_matrix(spark, folder)), "diff")


PERMUTED = (
    "pa AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS spot FROM embeddings)",
    f"pb AS (SELECT vec_id AS old_key, embedding, row_number() OVER (ORDER BY {S.key(42, 'vec_id')}) AS spot FROM embeddings)",
    "permuted AS (SELECT vec_id, old_key, embedding FROM pa JOIN pb USING (spot))",
)


def _embeddings(spark, folder):
    return spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")


@query(
    S.with_(*PERMUTED)
    + "SELECT vec_id, old_key, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM permuted p "
    + "JOIN embeddings a USING (vec_id) JOIN embeddings b ON b.vec_id = p.old_key WHERE p.vec_id <> p.old_key"
)
def cosine_pairs(spark, folder):
    """Similarity of every row to the row that replaces it."""
    emb = _embeddings(spark, folder)
    moved = settle(W.permute_rows(emb, "vec_id", "embedding", I.SEED).select("vec_id", "old_key"), "moved")
    return rounded(A.cosine_pairs(emb, "vec_id", "embedding", moved, "vec_id", "old_key"), "cos")


@query(
    S.with_(*PERMUTED)
    + "SELECT q.old_key AS vec_id, r.old_key, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM permuted p "
    + "JOIN embeddings a USING (vec_id) JOIN embeddings b ON b.vec_id = p.old_key JOIN permuted q ON q.vec_id = p.vec_id JOIN permuted r ON r.vec_id = p.old_key "
    + "WHERE p.vec_id <> p.old_key"
)
def cosine_pairs_renamed(spark, folder):
    """The same similarities, each row called by the one that replaces it."""
    emb = _embeddings(spark, folder)
    moved = settle(W.permute_rows(emb, "vec_id", "embedding", I.SEED).select("vec_id", "old_key"), "moved")
    names = moved.select(F.col("vec_id").alias("src"), F.col("old_key").alias("dst"))
    return rounded(A.cosine_pairs(emb, "vec_id", "embedding", moved, "vec_id", "old_key", names), "cos")


COSINES = "SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM {t} a, {t} b WHERE a.vec_id <> b.vec_id"


@query(
    f"SELECT vec_id, round(avg(c), 6) AS mean_cos, round(stddev_pop(c), 6) AS std_cos FROM ({COSINES.format(t='embeddings')}) GROUP BY vec_id"
)
def proximity_stats(spark, folder):
    return rounded(A.proximity_stats(_embeddings(spark, folder), "vec_id", "embedding"), "mean_cos", "std_cos")


@query(
    S.with_(*PERMUTED)
    + f"SELECT vec_id, round(corr(x.c, y.c), 6) AS corr FROM ({COSINES.format(t='embeddings')}) x JOIN ({COSINES.format(t='permuted')}) y USING (vec_id, other) GROUP BY vec_id"
)
def proximity_corr(spark, folder):
    emb = _embeddings(spark, folder)
    moved = settle(W.permute_rows(emb, "vec_id", "embedding", I.SEED).select("vec_id", "embedding"), "moved")
    return rounded(A.proximity_corr(emb, moved, "vec_id", "embedding"), "corr")


LAYERS = "layers AS (SELECT lang AS task, (n_chars % 7)::INT AS layer, avg(n_chars)::DOUBLE AS probe, avg(n_chars + doc_id % 100)::DOUBLE AS control FROM documents GROUP BY ALL)"


def _layers(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs.groupBy(F.col("lang").alias("task"), (F.col("n_chars") % 7).cast("int").alias("layer")).agg(
        F.avg("n_chars").alias("probe"), F.avg(F.col("n_chars") + F.col("doc_id") % 100).alias("control")
    )


@query(
    S.with_(LAYERS, "best AS (SELECT task, max(greatest(probe, control)) AS best FROM layers GROUP BY task)")
    + "SELECT task, layer, round(probe / best, 6) AS probe, round(control / best, 6) AS control, "
    + "round((control / best - probe / best) * 100 / (control / best), 1) AS drop_pct, -round((control / best - probe / best) * 100 / (control / best), 1) AS selectivity "
    + "FROM layers JOIN best USING (task)"
)
def selectivity(spark, folder):
    return rounded(A.selectivity(_layers(spark, folder)), "probe", "control")


@query(S.with_(LAYERS) + "SELECT task, layer, round(probe, 6) AS probe, round(control, 6) AS control, round((control - probe) * 100 / control, 1) AS change_pct FROM layers")
def rel_change(spark, folder):
    return rounded(A.rel_change(_layers(spark, folder), "probe", "control"), "probe", "control")


@query(
    S.with_(LAYERS, "first AS (SELECT task, min_by(probe, layer) AS base FROM layers GROUP BY task)")
    + "SELECT task, layer, round(probe, 6) AS probe, round((probe - base) * 100 / base, 1) AS change_pct FROM layers JOIN first USING (task)"
)
def zero_shot_change(spark, folder):
    return rounded(A.zero_shot_change(_layers(spark, folder), "task", "layer", "probe"), "probe")


@query(
    S.with_(
        S.DOC_TOKENS,
        S.DOC_FREQ,
        S.VOCAB,
        S.swap_rank("vocab"),
        "sources AS (SELECT src AS label, row_number() OVER (ORDER BY src) - 1 AS spot FROM swaps)",
        f"control AS (SELECT dst, label FROM (SELECT dst, {S.integer(42, 'dst')} % (SELECT count(*) FROM swaps) AS spot FROM swaps) JOIN sources USING (spot))",
        "words AS (SELECT doc_id, CASE WHEN doc_id % 10 < 2 THEN 'test' ELSE 'train' END AS part, unnest(list_distinct(toks)) AS token FROM doc_tokens)",
        "probes AS (SELECT w.doc_id, w.part, w.token, s.src AS word, c.label AS control_word FROM words w JOIN swaps s ON s.dst = w.token JOIN control c ON c.dst = w.token)",
        "kinds AS (SELECT doc_id, part, token, 'word' AS kind, word AS label FROM probes UNION ALL SELECT doc_id, part, token, 'control', control_word FROM probes)",
    )
    + "SELECT doc_id, part, token, kind, label FROM kinds k WHERE part = 'train' OR EXISTS (SELECT 1 FROM kinds t WHERE t.part = 'train' AND t.kind = k.kind AND t.label = k.label)"
)
def probe_rows(spark, folder):
    mapping = settle(W.swap_rank(I.vocabulary(spark, folder)), "map")
    control = W.control_map(mapping, I.SEED)
    part = F.when(F.col("doc_id") % 10 < 2, "test").otherwise("train")
    words = I.documents(spark, folder).select(
        "doc_id", part.alias("part"), F.explode_outer(F.array_distinct(I.tokens())).alias("token")
    ).where("token is not null")
    return A.probe_rows(settle(words, "words"), ["doc_id"], "token", "part", mapping, control)
