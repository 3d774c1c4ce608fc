"""Queries that rewrite, reorder, sample and select datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordmill.functions.text import basic_tokens, reverse_words as reversed_words, shuffle_words as shuffled_words
from wordmill.operators import rewrite as R
from wordmill.operators import swap as W
from wordmill.operators.scale import settle
from wordmill.operators.vocab import doc_freq
from wordmill.operators.wordpiece import vocab_table
from wordmill.plans import inputs as I
from wordmill.plans import sql as S
from wordmill.plans.registry import query
from wordmill.session import load

BASE = (S.DOC_TOKENS, S.DOC_ROWS, S.DOC_FREQ, S.VOCAB, S.swap_rank("vocab"))
GLUE = "trim(replace(string_agg(coalesce(dst, token), ' ' ORDER BY pos), ' ##', ''))"
SWAPPED = f"swapped AS (SELECT doc_id, {GLUE} AS swapped FROM doc_rows LEFT JOIN swaps ON src = token GROUP BY doc_id)"


def _map(spark, folder):
    vocab = I.vocabulary(spark, folder)
    return settle(W.weighed(W.swap_rank(vocab), vocab), "map")


@query(S.with_(*BASE, SWAPPED) + f"SELECT doc_id, CASE WHEN {S.present('text')} THEN coalesce(swapped, '') ELSE text END AS text, lang FROM documents LEFT JOIN swapped USING (doc_id)")
def apply_swap(spark, folder):
    """The flagship: profile the documents, match words by frequency, rewrite every text."""
    docs = I.documents(spark, folder).select("doc_id", "text", "lang")
    return R.apply_swap(docs, "doc_id", ["text"], _map(spark, folder))


PAIR_MAP = (
    S.PAIRS,
    f"df AS (SELECT token, count(*) AS freq FROM (SELECT unnest(list_concat(list_distinct({S.tok('first')}), list_distinct({S.tok('second')}))) AS token FROM pairs) GROUP BY token)",
    S.VOCAB,
    S.swap_rank("vocab"),
)


def _pair_field(col: str) -> str:
    return (
        f"(SELECT pair_id, {GLUE} AS {col} FROM (SELECT pair_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos "
        f"FROM (SELECT pair_id, {S.tok(col)} AS toks FROM pairs)) LEFT JOIN swaps ON src = token GROUP BY pair_id)"
    )


@query(S.with_(*PAIR_MAP) + f"SELECT pair_id, coalesce(a.first, '') AS first, coalesce(b.second, '') AS second FROM pairs p LEFT JOIN {_pair_field('first')} a USING (pair_id) LEFT JOIN {_pair_field('second')} b USING (pair_id)")
def apply_swap_pairs(spark, folder):
    pairs = I.pairs(spark, folder)
    vocab = settle(vocab_table(doc_freq(pairs, ["first", "second"])), "vocab")
    return R.apply_swap(pairs, "pair_id", ["first", "second"], settle(W.weighed(W.swap_rank(vocab), vocab), "map"))


@query(S.with_(*BASE) + "SELECT doc_id, coalesce(string_agg(dst, ' ' ORDER BY pos), '') AS tokens FROM documents LEFT JOIN doc_rows USING (doc_id) LEFT JOIN swaps ON src = token GROUP BY doc_id")
def apply_swap_tokens(spark, folder):
    docs = I.documents(spark, folder).select("doc_id", basic_tokens("text").alias("tokens"))
    swapped = R.apply_swap_tokens(docs, "doc_id", "tokens", _map(spark, folder))
    return swapped.select("doc_id", I.joined("tokens").alias("tokens"))


@query(f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY {S.key(42, 'doc_id')}) AS rn FROM documents) WHERE rn <= (SELECT floor(count(*) * 0.3) FROM documents)")
def sample_exact(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return R.sample_exact(docs, "doc_id", I.SEED, frac=0.3).select("doc_id", "lang")


@query(f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY {S.key(7, 'doc_id')}) AS rn FROM documents) WHERE rn <= 137")
def sample_n(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return R.sample_exact(docs, "doc_id", 7, n=137).select("doc_id", "lang")


def _window(keycol: str, table: str, out: str, p: float) -> str:
    """Rows (key, pos, token) with window bounds, reordered inside the window."""
    start = f"{S.integer('42|start', keycol)} % (n - w + 1)"
    return f"""
{out}_w AS (SELECT *, {start} AS s FROM (SELECT {keycol}, toks, len(toks) AS n, floor(len(toks) * {p}::DOUBLE)::INT AS w FROM {table})),
{out}_r AS (SELECT {keycol}, s, w, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM {out}_w),
{out}_o AS (
  SELECT {keycol}, token, pos FROM {out}_r WHERE pos < s OR pos >= s + w
  UNION ALL
  SELECT {keycol}, token, s + row_number() OVER (PARTITION BY {keycol} ORDER BY {S.key(42, keycol, '(pos - s)')}) - 1 FROM {out}_r WHERE pos >= s AND pos < s + w),
{out} AS (SELECT {keycol}, trim(replace(string_agg(token, ' ' ORDER BY pos), ' ##', '')) AS text FROM {out}_o GROUP BY {keycol})"""


def _field_window(key: str, col: str, source: str, p: float) -> str:
    base = f"{col}_src AS (SELECT {key}, '{col}|' || {key} AS k, {S.tok(col)} AS toks FROM {source})"
    return base + "," + _window("k", f"{col}_src", f"{col}_out", p)


@query(S.with_(_field_window("doc_id", "text", "documents", 0.5)) + "SELECT doc_id, coalesce(text_out.text, '') AS text FROM text_src LEFT JOIN text_out USING (k)")
def scramble_window(spark, folder):
    docs = I.documents(spark, folder).select("doc_id", "text")
    return R.scramble_windows(docs, "doc_id", ["text"], 0.5, I.SEED)


@query(
    S.with_(S.PAIRS, _field_window("pair_id", "first", "pairs", 0.25), _field_window("pair_id", "second", "pairs", 0.25))
    + "SELECT pair_id, coalesce(a.text, '') AS first, coalesce(b.text, '') AS second FROM first_src x JOIN second_src y USING (pair_id) "
    + "LEFT JOIN first_out a ON a.k = x.k LEFT JOIN second_out b ON b.k = y.k"
)
def scramble_window_pairs(spark, folder):
    return R.scramble_windows(I.pairs(spark, folder), "pair_id", ["first", "second"], 0.25, I.SEED)


@query("SELECT doc_id, array_to_string(list_reverse(string_split(text, ' ')), ' ') AS text FROM documents")
def reverse_words(spark, folder):
    return I.documents(spark, folder).select("doc_id", reversed_words("text").alias("text"))


SHUFFLED = f"string_agg(w, ' ' ORDER BY {S.key(42, 'doc_id', 'pos')}, pos)"


@query(
    f"SELECT doc_id, {SHUFFLED} AS text FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos "
    "FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)) GROUP BY doc_id"
)
def shuffle_words(spark, folder):
    return I.documents(spark, folder).select("doc_id", shuffled_words("text", "doc_id", I.SEED).alias("text"))


@query(
    S.with_(
        *BASE,
        SWAPPED,
        f"chosen AS (SELECT doc_id, text FROM (SELECT *, row_number() OVER (ORDER BY {S.key(42, 'doc_id')}) AS rn FROM documents) WHERE rn <= 5)",
        f"parts AS (SELECT doc_id, text, swapped, unnest(string_split(swapped, ' ')) AS w, generate_subscripts(string_split(swapped, ' '), 1) - 1 AS pos FROM chosen JOIN swapped USING (doc_id))",
    )
    + f"SELECT doc_id, any_value(text) AS original, any_value(swapped) AS swapped, {SHUFFLED} AS reordered FROM parts GROUP BY doc_id"
)
def preview(spark, folder):
    docs = I.documents(spark, folder).select("doc_id", "text")
    return R.preview(docs, "doc_id", "text", _map(spark, folder), 5, I.SEED)


@query("SELECT text, max_by(doc_id, doc_id) AS doc_id, max_by(lang, doc_id) AS lang FROM documents GROUP BY text")
def dedup_text(spark, folder):
    return R.dedup_text(I.documents(spark, folder), "text", "doc_id", ["doc_id", "lang"])


@query("SELECT doc_id, source FROM documents WHERE source = 'src1'")
def by_source(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return R.by_source(docs, "src1").select("doc_id", "source")


@query(
    f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {S.key(42, 'doc_id')}) AS rn FROM documents) "
    "WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))"
)
def downsample_min(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return R.downsample_min(docs, "doc_id", "lang", I.SEED).select("doc_id", "lang")


@query(
    f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {S.key(42, 'doc_id')}) <= floor((SELECT count(*) FROM documents) * 0.9) THEN 'train' ELSE 'dev' END AS part FROM documents"
)
def split_exact(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return R.split_exact(docs, "doc_id", 0.9, I.SEED).select("doc_id", "part")


@query("SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 250")
def cap_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "n_chars")
    return R.cap_rows(docs, "doc_id", 250)


@query(S.with_(S.PAIRS) + "SELECT first AS sentence1, second AS sentence2, (pair_id % 2)::BIGINT AS label FROM pairs")
def training_view(spark, folder):
    rows = I.pairs(spark, folder).select(
        "pair_id", F.col("first").alias("sentence1"), F.col("second").alias("sentence2"), (F.col("pair_id") % 2).alias("label")
    )
    return R.training_view(rows, "mrpc")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN '0' WHEN 'fr' THEN '1' WHEN 'de' THEN '-1' ELSE 'none' END AS lang FROM documents")
def map_labels(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.when(F.col("lang") == "de", "-1").otherwise(F.col("lang")).alias("lang"))
    mapped = R.map_labels(docs, "lang", {"en": 0, "fr": 1})
    return mapped.withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit("none")))
