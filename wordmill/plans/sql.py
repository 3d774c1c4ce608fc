"""SQL fragments of the comparison queries (DuckDB dialect)."""

from __future__ import annotations

from wordmill.functions.fixed import CJK_RANGES

CJK = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in CJK_RANGES)
CONTROL = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{Cf}\p{Co}]"
PUNCT = r"[\p{P}$+<=>^`|~]"


def clean(x: str) -> str:
    dropped = rf"regexp_replace({x}, '{CONTROL}', '', 'g')"
    return rf"regexp_replace({dropped}, '[\p{{Zs}}\t\n\r]', ' ', 'g')"


def spaced(x: str) -> str:
    return rf"regexp_replace({x}, '([{CJK}])', ' \1 ', 'g')"


def folded(x: str) -> str:
    return f"strip_accents(lower({x}))"


def punct(x: str) -> str:
    return rf"regexp_replace({x}, '({PUNCT})', ' \1 ', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[\s\p{{Z}}]+'), lambda t: t <> '')"


def tok(x: str) -> str:
    return words(punct(folded(spaced(clean(x)))))


def present(x: str) -> str:
    return rf"coalesce(regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') NOT IN ('', 'None'), false)"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def key(seed: object, *parts: str) -> str:
    return "md5('" + str(seed) + "'" + "".join(f" || '|' || {p}" for p in parts) + ")"


def integer(seed: object, *parts: str) -> str:
    return f"('0x' || substr({key(seed, *parts)}, 1, 8))::BIGINT"


def unit(seed: object, *parts: str) -> str:
    return f"({integer(seed, *parts)} / 4294967296.0::DOUBLE)"


def lev(a: str, b: str) -> str:
    """Edit distance in characters: the SQL engine counts bytes, and the one letter of the folded tables
    that takes two is put into one. (Folded words have no capitals.)"""
    return f"levenshtein(replace({a}, 'ß', 'S'), replace({b}, 'ß', 'S'))"


def norm_lev(a: str, b: str) -> str:
    longest = f"greatest(length({a}), length({b}))"
    return f"(CASE WHEN {longest} = 0 THEN 0 ELSE {lev(a, b)}::DOUBLE / {longest} END)"


DOC_TOKENS = f"doc_tokens AS MATERIALIZED (SELECT doc_id, {tok('text')} AS toks FROM documents)"
DOC_ROWS = (
    "doc_rows AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM doc_tokens)"
)
TERM_FREQ = "tf AS MATERIALIZED (SELECT token, count(*) AS freq FROM (SELECT unnest(toks) AS token FROM doc_tokens) GROUP BY token)"
DOC_FREQ = "df AS MATERIALIZED (SELECT token, count(*) AS freq FROM (SELECT unnest(list_distinct(toks)) AS token FROM doc_tokens) GROUP BY token)"
PIECES = """vocab_chars AS (SELECT DISTINCT unnest(list_transform(range(1, length(token) + 1), lambda i: substr(token, i, 1))) AS token FROM tf),
piece_vocab AS (
  SELECT token FROM tf WHERE freq >= 5 UNION SELECT token FROM vocab_chars UNION SELECT '##' || token FROM vocab_chars),
heads AS (
  SELECT w.token, max(w.k) AS head
  FROM (SELECT token, unnest(range(1, length(token) + 1)) AS k FROM tf WHERE length(token) <= 100) w
  JOIN piece_vocab v ON v.token = substr(w.token, 1, w.k) GROUP BY w.token),
pieced AS MATERIALIZED (
  SELECT tf.token, CASE WHEN head IS NULL THEN ['[UNK]'] ELSE list_concat(
      [substr(tf.token, 1, head)],
      list_transform(range(head + 1, length(tf.token) + 1), lambda i: '##' || substr(tf.token, i, 1))) END AS pieces
  FROM tf LEFT JOIN heads USING (token))"""
PAIRS = """pairs AS (
  SELECT a.conv_id * 100000 + a.turn AS pair_id, a.text AS first, b.text AS second
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn
  WHERE a.role = 'user' AND b.role = 'assistant')"""
LABELLED = """labelled AS (
  SELECT d.*, l.quality, l.toxic,
         CASE WHEN n_chars % 3 = 0 THEN 1 - l.quality ELSE l.quality END AS pred
  FROM documents d JOIN labels l USING (doc_id))"""
SPLITS = """split_docs AS (
  SELECT *, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split,
         CASE doc_id % 10 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS split_ord
  FROM documents)"""


def edges(freq: str, points: int) -> str:
    """One row of bucket edges over a frequency table."""
    return (
        f"edges AS (SELECT list_transform(range(0, {points - 1}), lambda i: "
        f"ceil(round(pow(10.0::DOUBLE, log10(lo) + i * (log10(hi) - log10(lo)) / {points - 1}), 9))::BIGINT) AS e "
        f"FROM (SELECT min(freq) AS lo, max(freq) AS hi FROM {freq}))"
    )


def bucket(freq: str = "freq") -> str:
    return f"least(len(list_filter(e, lambda x: x < {freq})) + 1, len(e))"


def buckets(freq: str, points: int) -> str:
    return f"{edges(freq, points)}, buckets AS (SELECT token, freq, {bucket()} AS bucket FROM {freq}, edges)"


def swap_rank(vocab: str, out: str = "swaps") -> str:
    """Neighbour swap over ``vocab(token, freq, n_pieces)``."""
    return f"""
sr_ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY n_pieces ORDER BY freq DESC, md5(token)) AS rn FROM {vocab}),
sr_first AS MATERIALIZED (
  SELECT n_pieces, (rn - 1) // 2 AS pair, min_by(token, rn) AS a, max_by(token, rn) AS b, min_by(freq, rn) AS fa, max_by(freq, rn) AS fb
  FROM sr_ranked GROUP BY ALL HAVING count(*) = 2),
sr_ok AS MATERIALIZED (SELECT *, {norm_lev('a', 'b')} > 0.3 AS ok FROM sr_first),
sr_refused AS MATERIALIZED (
  SELECT n_pieces, a AS token, fa AS freq FROM sr_ok WHERE NOT ok UNION ALL SELECT n_pieces, b, fb FROM sr_ok WHERE NOT ok),
sr_again AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY n_pieces ORDER BY freq DESC, md5(token)) AS rn FROM sr_refused),
sr_second AS MATERIALIZED (
  SELECT n_pieces, rn // 2 AS pair, min_by(token, rn) AS a, max_by(token, rn) AS b FROM sr_again GROUP BY ALL HAVING count(*) = 2),
sr_good AS MATERIALIZED (
  SELECT a, b FROM sr_ok WHERE ok UNION ALL SELECT a, b FROM sr_second WHERE {norm_lev('a', 'b')} > 0.3),
sr_both AS MATERIALIZED (SELECT a AS src, b AS dst FROM sr_good UNION ALL SELECT b, a FROM sr_good),
{out} AS (SELECT v.token AS src, coalesce(m.dst, v.token) AS dst FROM {vocab} v LEFT JOIN sr_both m ON m.src = v.token)"""


def permuted(table: str, order: str) -> str:
    """Places of the words of ``table(token)`` in an order (a) and in seeded hash order (b): a is swapped for b of the same place."""
    return (
        f"a AS (SELECT token, row_number() OVER (ORDER BY {order}) AS spot FROM {table}), "
        f"b AS (SELECT token, row_number() OVER (ORDER BY {key(42, 'token')}) AS spot FROM {table})"
    )


VOCAB = "vocab AS (SELECT token, freq, 1 AS n_pieces FROM df)"
PIECED_VOCAB = "pvocab AS MATERIALIZED (SELECT df.token, df.freq, len(pieces)::INT AS n_pieces FROM df JOIN pieced USING (token))"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
