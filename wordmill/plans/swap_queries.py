"""Queries over word-substitution maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordmill.operators import swap as W
from wordmill.operators.scale import numbered, settle
from wordmill.operators.vocab import doc_freq, term_freq
from wordmill.operators.wordpiece import vocab_table
from wordmill.plans import inputs as I
from wordmill.plans import sql as S
from wordmill.plans.registry import query
from wordmill.session import load

BASE = (S.DOC_TOKENS, S.DOC_FREQ, S.VOCAB)
PIECED = (S.DOC_TOKENS, S.TERM_FREQ, S.DOC_FREQ, S.PIECES, S.PIECED_VOCAB)


@query(S.with_(*BASE, S.swap_rank("vocab")) + "SELECT src, dst FROM swaps")
def swap_rank(spark, folder):
    return W.swap_rank(I.vocabulary(spark, folder))


@query(S.with_(*PIECED, S.swap_rank("pvocab")) + "SELECT src, dst FROM swaps")
def swap_rank_by_pieces(spark, folder):
    return W.swap_rank(I.pieced_vocabulary(spark, folder))


@query()
def swap_greedy(spark, folder):
    return W.swap_greedy(I.vocabulary(spark, folder))


@query()
def swap_greedy_by_pieces(spark, folder):
    return W.swap_greedy(I.pieced_vocabulary(spark, folder))


def _stems(vocab):
    return vocab.withColumn("forms", F.array(F.substring("token", 1, 5)))


@query()
def swap_greedy_lemma(spark, folder):
    return W.swap_greedy(_stems(I.pieced_vocabulary(spark, folder)), forms="forms")


TASK = f"task AS MATERIALIZED (SELECT token, count(*) AS freq FROM (SELECT unnest(list_distinct({S.tok('text')})) AS token FROM benchmark) GROUP BY token)"


def _greedy_sql(unrelated: str) -> str:
    """The sequential rule, word by word: the list of words still single travels along the frequency order."""
    return (
        "WITH RECURSIVE " + TASK + ", r AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY freq DESC, md5(token)) AS rn FROM task), "
        "walk(rn, token, singles, partner) AS ("
        "SELECT 0::BIGINT, NULL::VARCHAR, []::VARCHAR[], NULL::VARCHAR UNION ALL "
        "SELECT rn, token, CASE WHEN spot IS NULL THEN list_append(singles, token) ELSE list_concat(singles[1:spot - 1], singles[spot + 1:]) END, singles[spot] "
        f"FROM (SELECT r.rn, r.token, w.singles, nullif(list_position(list_transform(w.singles, lambda s: {unrelated}), true), 0) AS spot FROM walk w JOIN r ON r.rn = w.rn + 1)), "
        "pairs AS (SELECT token AS src, partner AS dst FROM walk WHERE partner IS NOT NULL UNION ALL SELECT partner, token FROM walk WHERE partner IS NOT NULL) "
        "SELECT token AS src, coalesce(dst, token) AS dst FROM task LEFT JOIN pairs ON src = token"
    )


def _benchmark_vocabulary(spark, folder):
    return settle(vocab_table(doc_freq(load(spark, folder, "benchmark"), ["text"])), "vocab")


@query(_greedy_sql(f"{S.norm_lev('s', 'r.token')} > 0.3"))
def swap_greedy_benchmark(spark, folder):
    """The greedy map of the benchmark's words, few enough for a walk in SQL."""
    return W.swap_greedy(_benchmark_vocabulary(spark, folder))


@query(_greedy_sql(f"{S.norm_lev('s', 'r.token')} > 0.3 AND substr(s, 1, 5) <> substr(r.token, 1, 5)"))
def swap_greedy_lemma_benchmark(spark, folder):
    return W.swap_greedy(_stems(_benchmark_vocabulary(spark, folder)), forms="forms")


@query()
def swap_lemma(spark, folder):
    return W.swap_lemma(settle(_stems(I.pieced_vocabulary(spark, folder)), "stems"), "forms", I.SEED)


def _lemma_sql(unrelated) -> str:
    """The half-turn of each bucket of the benchmark's words, then its trades one after the other on the list of its targets."""
    return "WITH RECURSIVE " + ",\n".join(
        [
            TASK,
            """levels AS (SELECT freq, count(*) AS n, row_number() OVER (ORDER BY freq) AS rn FROM task GROUP BY freq),
walk AS (
  SELECT rn, 0 AS id, CASE WHEN n >= 10 THEN 0 ELSE n END AS held, CASE WHEN n >= 10 THEN 1 ELSE 0 END AS closed FROM levels WHERE rn = 1
  UNION ALL
  SELECT l.rn, w.closed, CASE WHEN w.held + l.n >= 10 THEN 0 ELSE w.held + l.n END, w.closed + CASE WHEN w.held + l.n >= 10 THEN 1 ELSE 0 END
  FROM walk w JOIN levels l ON l.rn = w.rn + 1),
bucketed AS (SELECT token, least(id, (SELECT greatest(max(closed) - 1, 0) FROM walk)) AS bucket FROM task JOIN levels USING (freq) JOIN walk USING (rn))""",
            f"""placed AS MATERIALIZED (
  SELECT token, bucket, row_number() OVER (PARTITION BY bucket ORDER BY {S.key(42, "token")}) - 1 AS spot, count(*) OVER (PARTITION BY bucket) AS n FROM bucketed),
turned AS MATERIALIZED (
  SELECT a.*, b.token AS dst FROM placed a JOIN placed b ON a.bucket = b.bucket AND b.spot = (a.spot - a.n // 2 + a.n) % a.n),
trades AS MATERIALIZED (
  SELECT c.bucket, c.spot, c.dst, min(p.spot) AS partner FROM turned c JOIN placed p ON p.bucket = c.bucket
  WHERE NOT ({unrelated("c.token", "c.dst")}) AND {unrelated("c.token", "p.token")} GROUP BY c.bucket, c.spot, c.dst),
ordered AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY spot) AS k FROM trades),
chain AS (
  SELECT bucket, 0::BIGINT AS k, list(dst ORDER BY spot) AS cells FROM turned GROUP BY bucket
  UNION ALL
  SELECT c.bucket, o.k, list_transform(c.cells, lambda x, i: CASE WHEN i = o.spot + 1 THEN c.cells[o.partner + 1] WHEN i = o.partner + 1 THEN o.dst ELSE x END)
  FROM chain c JOIN ordered o ON o.bucket = c.bucket AND o.k = c.k + 1),
settled AS (SELECT bucket, arg_max(cells, k) AS cells FROM chain GROUP BY bucket)
""",
        ]
    ) + "SELECT token AS src, cells[spot + 1] AS dst FROM placed JOIN settled USING (bucket)"


@query(_lemma_sql(lambda a, b: f"({S.norm_lev(a, b)} > 0.3 AND substr({a}, 1, 1) <> substr({b}, 1, 1))"))
def swap_lemma_benchmark(spark, folder):
    """The lemma map of the benchmark's words; words with the same first letter count as related, so that many trade."""
    vocab = _benchmark_vocabulary(spark, folder).withColumn("forms", F.array(F.substring("token", 1, 1)))
    return W.swap_lemma(vocab, "forms", I.SEED)


@query(S.with_(*BASE, S.permuted("df", "freq DESC, md5(token)")) + "SELECT a.token AS src, b.token AS dst FROM a JOIN b USING (spot)")
def swap_random(spark, folder):
    return W.swap_random(I.vocabulary(spark, folder), I.SEED)


@query(S.with_(*BASE, S.permuted("df", "token")) + "SELECT a.token AS src, b.token AS dst FROM a JOIN b USING (spot)")
def swap_random_alphabetical(spark, folder):
    return W.swap_random(I.vocabulary(spark, folder), I.SEED, order=[F.col("token")])


PLACED = f"""placed AS MATERIALIZED (
  SELECT token, n_pieces, row_number() OVER (PARTITION BY n_pieces ORDER BY {S.key(42, 'token')}) - 1 AS spot, count(*) OVER (PARTITION BY n_pieces) AS n
  FROM pvocab)"""


@query(
    S.with_(
        *PIECED,
        PLACED,
        f"turned AS (SELECT *, CASE WHEN n > 1 THEN 1 + {S.integer('42|turn', 'n_pieces')} % (n - 1) ELSE 0 END AS k FROM placed)",
    )
    + "SELECT a.token AS src, b.token AS dst FROM turned a JOIN placed b ON a.n_pieces = b.n_pieces AND b.spot = (a.spot - a.k + a.n) % a.n"
)
def swap_rotate(spark, folder):
    return W.swap_rotate(I.pieced_vocabulary(spark, folder), I.SEED)


@query(
    S.with_(*PIECED, PLACED)
    + "SELECT a.token AS src, b.token AS dst FROM placed a JOIN placed b ON a.n_pieces = b.n_pieces AND b.spot = "
    + "CASE WHEN a.spot < a.n // 2 THEN a.spot + a.n // 2 WHEN a.spot < 2 * (a.n // 2) THEN a.spot - a.n // 2 ELSE a.spot END"
)
def swap_mutual(spark, folder):
    return W.swap_mutual(I.pieced_vocabulary(spark, folder), I.SEED)


@query(
    S.with_(
        *PIECED,
        "letters AS (SELECT chr((97 + i)::INT) AS c FROM range(26) t(i))",
        "strings AS (SELECT a.c || b.c || c.c || d.c AS s FROM letters a, letters b, letters c, letters d)",
        "fit AS (SELECT s FROM strings WHERE NOT EXISTS (SELECT 1 FROM piece_vocab v WHERE v.token = substr(s, 1, 2)) "
        "AND NOT EXISTS (SELECT 1 FROM piece_vocab v WHERE v.token = substr(s, 1, 3)) AND NOT EXISTS (SELECT 1 FROM piece_vocab v WHERE v.token = s) "
        "AND list_aggregate(list_transform(range(1, 5), lambda i: CASE WHEN substr(s, i, 1) IN (SELECT token FROM vocab_chars) THEN 1 ELSE 0 END), 'sum') = 4)",
        "there AS (SELECT s, row_number() OVER (ORDER BY s) AS spot FROM fit)",
        f"here AS (SELECT token, row_number() OVER (ORDER BY {S.key(42, 'token')}) AS spot FROM df)",
    ).replace(
        "AND list_aggregate(list_transform(range(1, 5), lambda i: CASE WHEN substr(s, i, 1) IN (SELECT token FROM vocab_chars) THEN 1 ELSE 0 END), 'sum') = 4",
        "".join(f"AND substr(s, {i}, 1) IN (SELECT token FROM vocab_chars) " for i in range(1, 5)),
    )
    + "SELECT token AS src, s AS dst FROM here JOIN there USING (spot)"
)
def swap_nonsense(spark, folder):
    return W.swap_nonsense(I.vocabulary(spark, folder), I.piece_table(spark, folder), I.SEED)


def _task(spark, folder):
    return settle(doc_freq(load(spark, folder, "benchmark"), ["text"]), "task")


TASK = (
    S.DOC_TOKENS,
    S.DOC_FREQ,
    f"task AS (SELECT token, count(*) AS freq FROM (SELECT unnest(list_distinct({S.tok('text')})) AS token FROM benchmark) GROUP BY token)",
    "ranked AS (SELECT token, row_number() OVER (ORDER BY freq DESC, md5(token)) AS spot, count(*) OVER () AS n FROM task)",
    "unseen AS (SELECT * FROM df WHERE token NOT IN (SELECT token FROM task))",
)


@query(
    S.with_(
        *TASK,
        f"sample AS (SELECT token, freq FROM (SELECT *, row_number() OVER (ORDER BY {S.key(42, 'token')}) AS k FROM unseen) WHERE k <= (SELECT count(*) FROM task))",
        "there AS (SELECT token, row_number() OVER (ORDER BY freq DESC, md5(token)) AS spot FROM sample)",
    )
    + "SELECT r.token AS src, t.token AS dst FROM ranked r JOIN there t USING (spot)"
)
def swap_oov_similar(spark, folder):
    return W.swap_oov(_task(spark, folder), I.field_frequencies(spark, folder), I.SEED, "similar")


@query(
    S.with_(*TASK, f"there AS (SELECT token, row_number() OVER (ORDER BY {S.key(42, 'token')}) AS spot FROM unseen WHERE freq = 1)")
    + "SELECT r.token AS src, t.token AS dst FROM ranked r JOIN there t USING (spot)"
)
def swap_oov_rare(spark, folder):
    return W.swap_oov(_task(spark, folder), I.field_frequencies(spark, folder), I.SEED, "rare")


@query(
    S.with_(*TASK, "there AS (SELECT token, row_number() OVER (ORDER BY freq DESC, md5(token)) AS spot FROM unseen)")
    + "SELECT r.token AS src, t.token AS dst FROM ranked r JOIN there t ON t.spot = r.n + 1 - r.spot"
)
def swap_oov_inverted(spark, folder):
    return W.swap_oov(_task(spark, folder), I.field_frequencies(spark, folder), I.SEED, "inverted")


IDS = "ids AS (SELECT token, row_number() OVER (ORDER BY freq DESC, md5(token)) - 1 AS id FROM df)"
CATEGORY = (
    "CASE WHEN id <= 998 THEN 'a' WHEN id <= 1013 THEN 'b' WHEN id <= 1023 THEN 'c' WHEN id <= 1036 THEN 'd' "
    "WHEN id <= 1062 THEN 'e' WHEN id <= 1995 THEN 'f' ELSE 'g' || strlen(token) END"
)


@query(
    S.with_(
        *BASE,
        IDS,
        f"classed AS (SELECT *, {CATEGORY} AS cat FROM ids)",
        "here AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY id) AS spot FROM classed)",
        f"there AS (SELECT cat, token AS new_token, row_number() OVER (PARTITION BY cat ORDER BY {S.key(42, 'token')}) AS spot FROM classed)",
    )
    + "SELECT id, token, new_token FROM here JOIN there USING (cat, spot)"
)
def permute_vocab(spark, folder):
    ranked = W.freq_rank(I.field_frequencies(spark, folder))
    vocab = settle(ranked.select("token", (F.col("rank") - 1).alias("id")), "ids")
    return W.permute_vocab(vocab, I.SEED)


@query(
    S.with_(
        "a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS spot FROM embeddings)",
        f"b AS (SELECT vec_id AS old_key, embedding, row_number() OVER (ORDER BY {S.key(42, 'vec_id')}) AS spot FROM embeddings)",
    )
    + "SELECT vec_id, old_key, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM a JOIN b USING (spot)"
)
def permute_rows(spark, folder):
    emb = spark.read.parquet(f"{folder}/embeddings.parquet")
    end = lambda i: F.round(F.element_at("embedding", i).cast("double"), 6)
    return W.permute_rows(emb, "vec_id", "embedding", I.SEED).select("vec_id", "old_key", end(1).alias("first"), end(64).alias("last"))


@query(
    "SELECT dim::INT AS dim, round(avg(x::DOUBLE), 6) AS mean FROM "
    "(SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY dim"
)
def mean_vector(spark, folder):
    emb = spark.read.parquet(f"{folder}/embeddings.parquet")
    return W.mean_vector(emb, "embedding").select("dim", F.round("mean", 6).alias("mean"))


@query(
    S.with_(
        *BASE,
        S.swap_rank("vocab"),
        "sources AS (SELECT src AS label, row_number() OVER (ORDER BY src) - 1 AS spot, count(*) OVER () AS n FROM swaps)",
    )
    + f"SELECT dst, label FROM (SELECT dst, {S.integer(42, 'dst')} % (SELECT count(*) FROM swaps) AS spot FROM swaps) JOIN sources USING (spot)"
)
def control_map(spark, folder):
    return W.control_map(settle(W.swap_rank(I.vocabulary(spark, folder)), "map"), I.SEED)


@query(S.with_(*BASE, S.permuted("df", "freq DESC, md5(token)")) + "SELECT b.token AS src, a.token AS dst FROM a JOIN b USING (spot)")
def invert_map(spark, folder):
    return W.invert_map(W.swap_random(I.vocabulary(spark, folder), I.SEED))


@query(
    S.with_(*BASE, S.swap_rank("vocab"), "both AS (SELECT src AS a, dst AS b FROM swaps UNION SELECT dst, src FROM swaps)".replace("both", "two_way"))
    + f"SELECT a, b, round({S.norm_lev('a', 'b')}, 6) AS dist FROM two_way"
)
def lev_pairs(spark, folder):
    pairs = W.lev_pairs(W.swap_rank(I.vocabulary(spark, folder)))
    return pairs.withColumn("dist", F.round("dist", 6))


@query(
    S.with_(
        *BASE,
        "forms AS (SELECT token, token AS form FROM df UNION SELECT token, substr(token, 1, i - 1) || substr(token, i + 1) "
        "FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM df))",
        f"near AS (SELECT DISTINCT x.token AS a, y.token AS b FROM forms x JOIN forms y USING (form) WHERE {S.lev('x.token', 'y.token')} <= 1)",
    )
    + f"SELECT a, b, round(dist, 6) AS dist FROM (SELECT a, b, {S.norm_lev('a', 'b')} AS dist FROM near) WHERE dist <= 0.3"
)
def near_words(spark, folder):
    return W.near_words(I.field_frequencies(spark, folder)).withColumn("dist", F.round("dist", 6))


@query()
def near_pairs(spark, folder):
    """All pairs of document words within 0.3 of the longer length; all pairs are too many for SQL, see ``near_pairs_benchmark``."""
    return W.near_pairs(I.field_frequencies(spark, folder)).withColumn("dist", F.round("dist", 6))


@query(
    f"WITH words AS MATERIALIZED (SELECT DISTINCT unnest({S.tok('text')}) AS token FROM benchmark) "
    + f"SELECT x.token AS a, y.token AS b, round({S.norm_lev('x.token', 'y.token')}, 6) AS dist FROM words x, words y "
    f"WHERE length(x.token) > 0 AND length(y.token) > 0 AND {S.norm_lev('x.token', 'y.token')} <= 0.3"
)
def near_pairs_benchmark(spark, folder):
    vocab = settle(doc_freq(load(spark, folder, "benchmark"), ["text"]), "freq")
    return W.near_pairs(vocab).withColumn("dist", F.round("dist", 6))
