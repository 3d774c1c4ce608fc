"""Queries over vocabulary statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordmill.operators import swap as W
from wordmill.operators import vocab as V
from wordmill.operators.scale import settle
from wordmill.plans import inputs as I
from wordmill.plans import sql as S
from wordmill.plans.registry import query


@query(S.with_(S.DOC_TOKENS, S.DOC_FREQ) + "SELECT token, freq FROM df")
def doc_freq(spark, folder):
    return V.doc_freq(I.documents(spark, folder), ["text"])


FIELDS = f"fields AS (SELECT unnest(list_concat(list_distinct({S.tok('first')}), list_distinct({S.tok('second')}))) AS token FROM pairs)"


@query(S.with_(S.PAIRS, FIELDS) + "SELECT token, count(*) AS freq FROM fields GROUP BY token")
def doc_freq_pairs(spark, folder):
    return V.doc_freq(I.pairs(spark, folder), ["first", "second"])


@query(S.with_(S.DOC_TOKENS, S.TERM_FREQ) + "SELECT token, freq FROM tf")
def term_freq(spark, folder):
    return V.term_freq(I.documents(spark, folder), "text")


@query(
    "SELECT token, count(*) AS freq FROM (SELECT unnest(list_filter(string_split(text, ' '), lambda t: t <> '')) AS token FROM documents) GROUP BY token"
)
def term_freq_tokens(spark, folder):
    docs = I.documents(spark, folder).select(F.array_remove(F.split("text", " "), "").alias("tokens"))
    return V.term_freq(docs, "tokens", tokenised=True)


@query(
    S.with_(S.DOC_TOKENS, S.TERM_FREQ, S.DOC_FREQ, S.PIECES, S.PIECED_VOCAB)
    + "SELECT token, freq, n_pieces, row_number() OVER (PARTITION BY n_pieces ORDER BY freq DESC, md5(token)) AS rank FROM pvocab"
)
def vocab_table(spark, folder):
    return V.freq_rank(I.pieced_vocabulary(spark, folder), ["n_pieces"])


@query(S.with_(S.DOC_TOKENS, S.DOC_FREQ) + "SELECT token, freq, row_number() OVER (ORDER BY freq DESC, md5(token)) AS rank FROM df")
def freq_rank(spark, folder):
    return V.freq_rank(V.doc_freq(I.documents(spark, folder), ["text"]))


INDEX = f"""seen AS (
  SELECT unnest(toks) AS token, generate_subscripts(toks, 1) AS pos, split_ord, doc_id
  FROM (SELECT split_ord, doc_id, {S.tok('text')} AS toks FROM split_docs)),
firsts AS (SELECT token, min((split_ord, doc_id, pos)) AS f, count(*) AS freq FROM seen GROUP BY token),
idx AS (SELECT token, row_number() OVER (ORDER BY f) - 1 AS idx, freq FROM firsts)"""


@query(S.with_(S.SPLITS, INDEX) + "SELECT token, idx, freq FROM idx")
def vocab_index(spark, folder):
    return V.vocab_index(I.split_documents(spark, folder), "split_ord", "doc_id", ["text"])


@query(
    S.with_(S.DOC_TOKENS, S.TERM_FREQ, S.edges("tf", 25))
    + "SELECT generate_subscripts(e, 1)::INT AS bucket, unnest(e) AS edge FROM edges"
)
def log_edges(spark, folder):
    edges = V.log_edges(I.frequencies(spark, folder), 25)
    return edges.select(F.posexplode("edges").alias("p", "edge")).select((F.col("p") + 1).alias("bucket"), "edge")


@query(S.with_(S.DOC_TOKENS, S.TERM_FREQ, S.buckets("tf", 25)) + "SELECT token, freq, bucket::INT AS bucket FROM buckets")
def bucketize(spark, folder):
    return V.bucketize(I.frequencies(spark, folder), 25)


@query(S.with_(S.DOC_TOKENS, S.TERM_FREQ, S.buckets("tf", 256)) + "SELECT token, freq, bucket::INT AS bucket FROM buckets")
def bucketize_fine(spark, folder):
    return V.bucketize(I.frequencies(spark, folder), 256)


@query(S.with_(S.DOC_TOKENS, S.TERM_FREQ) + "SELECT token, freq, dense_rank() OVER (ORDER BY freq) - 1 AS bucket FROM tf")
def dense_bucket(spark, folder):
    return V.dense_bucket(I.frequencies(spark, folder))


@query(
    S.with_(S.DOC_TOKENS, S.TERM_FREQ)
    + f"SELECT token, freq, (ntile(600) OVER (ORDER BY {S.key(42, 'token')}) - 1)::INT AS bucket FROM tf"
)
def random_buckets(spark, folder):
    return V.random_buckets(I.frequencies(spark, folder), 600, I.SEED)


@query(
    "WITH RECURSIVE "
    + ",\n".join(
        [
            S.DOC_TOKENS,
            S.TERM_FREQ,
            S.DOC_FREQ,
            S.PIECES,
            S.PIECED_VOCAB,
            """levels AS (SELECT n_pieces, freq, count(*) AS n, row_number() OVER (PARTITION BY n_pieces ORDER BY freq) AS rn FROM pvocab GROUP BY n_pieces, freq),
walk AS (
  SELECT n_pieces, rn, 0 AS id, CASE WHEN n >= 10 THEN 0 ELSE n END AS held, CASE WHEN n >= 10 THEN 1 ELSE 0 END AS closed FROM levels WHERE rn = 1
  UNION ALL
  SELECT w.n_pieces, l.rn, w.closed, CASE WHEN w.held + l.n >= 10 THEN 0 ELSE w.held + l.n END, w.closed + CASE WHEN w.held + l.n >= 10 THEN 1 ELSE 0 END
  FROM walk w JOIN levels l ON l.n_pieces = w.n_pieces AND l.rn = w.rn + 1),
closing AS (SELECT n_pieces, greatest(max(closed) - 1, 0) AS top FROM walk GROUP BY n_pieces)
""",
        ]
    )
    + "SELECT v.token, v.freq, v.n_pieces, least(w.id, c.top)::INT AS bucket FROM pvocab v JOIN levels l USING (n_pieces, freq) "
    + "JOIN walk w ON w.n_pieces = l.n_pieces AND w.rn = l.rn JOIN closing c ON c.n_pieces = v.n_pieces"
)
def coarse_buckets(spark, folder):
    return V.coarse_buckets(I.pieced_vocabulary(spark, folder))


@query(S.with_(S.SPLITS) + "SELECT split, count(*) AS n_rows FROM split_docs GROUP BY split")
def split_stats(spark, folder):
    return V.split_stats(I.split_documents(spark, folder), "split")


@query("SELECT lang, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS prior FROM documents GROUP BY lang")
def label_prior(spark, folder):
    prior = V.label_prior(spark.read.parquet(f"{folder}/documents.parquet"), "lang")
    return prior.withColumn("prior", F.round("prior", 6))


DRIFT = S.with_(S.DOC_TOKENS, S.DOC_FREQ, S.VOCAB, S.swap_rank("vocab")) + (
    "SELECT s.src, s.dst, abs(a.freq - b.freq) AS freq_diff FROM swaps s JOIN df a ON a.token = s.src JOIN df b ON b.token = s.dst"
)


def _drift(spark, folder):
    vocab = I.vocabulary(spark, folder)
    return V.swap_freq_diff(W.swap_rank(vocab), vocab)


@query(DRIFT)
def swap_freq_diff(spark, folder):
    return _drift(spark, folder)


@query(
    f"WITH drift AS ({DRIFT}), span AS (SELECT min(freq_diff)::DOUBLE AS lo, max(freq_diff)::DOUBLE AS hi FROM drift) "
    + "SELECT (CASE WHEN hi = lo THEN 0 ELSE least(floor((freq_diff - lo) / ((hi - lo) / 50)), 49) END)::INT AS bin, count(*) AS n FROM drift, span GROUP BY 1"
)
def swap_freq_histogram(spark, folder):
    return V.histogram(settle(_drift(spark, folder), "drift"), "freq_diff", 50)


@query("SELECT lang AS label, row_number() OVER (ORDER BY lang) - 1 AS id FROM (SELECT DISTINCT lang FROM documents)")
def label_index(spark, folder):
    return V.label_index(spark.read.parquet(f"{folder}/documents.parquet"), "lang")


@query(
    S.with_(S.DOC_TOKENS)
    + "SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT unnest(list_transform(toks, lambda t: 'L' || length(t))) AS label FROM doc_tokens)"
)
def label_index_tags(spark, folder):
    docs = I.documents(spark, folder).select(
        F.transform(I.tokens(), lambda t: F.concat(F.lit("L"), F.length(t))).alias("tags")
    )
    return V.label_index(docs, "tags", is_array=True)


@query(S.with_(S.DOC_TOKENS, S.TERM_FREQ) + "SELECT freq, count(*) AS n_tokens FROM tf GROUP BY freq")
def freq_of_freq(spark, folder):
    return V.freq_of_freq(I.frequencies(spark, folder))
