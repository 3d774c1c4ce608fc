"""Queries over text normalisation, tokens, pieces and model inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordmill.functions import text as T
from wordmill.operators import wordpiece as P
from wordmill.operators.scale import numbered, settle
from wordmill.plans import inputs as I
from wordmill.plans import sql as S
from wordmill.plans.registry import query
from wordmill.session import load

EDGE = "CASE n_chars % 4 WHEN 0 THEN ' None ' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE text END"


@query(f"SELECT doc_id, {S.present('text')} AS whole, {S.present('edge')} AS edge FROM (SELECT *, {EDGE} AS edge FROM documents)")
def is_present(spark, folder):
    docs = I.documents(spark, folder).withColumn("edge", F.expr(EDGE))
    return docs.select("doc_id", T.is_present("text").alias("whole"), T.is_present("edge").alias("edge"))


@query(f"SELECT page_id, {S.clean('html')} AS cleaned FROM pages")
def clean_text(spark, folder):
    return load(spark, folder, "pages").select("page_id", T.clean_text("html").alias("cleaned"))


@query(f"SELECT doc_id, {S.spaced("text || '日本語' || lang")} AS spaced FROM documents")
def space_cjk(spark, folder):
    text = F.concat("text", F.lit("日本語"), "lang")
    return I.documents(spark, folder).select("doc_id", T.space_cjk(text).alias("spaced"))


@query(f"SELECT doc_id, {S.folded('text')} AS folded, lower(text) AS lowered FROM documents")
def fold_text(spark, folder):
    return I.documents(spark, folder).select(
        "doc_id", T.fold("text").alias("folded"), T.fold("text", strip=False).alias("lowered")
    )


@query(f"SELECT doc_id, {S.punct('text')} AS split FROM documents")
def split_punct(spark, folder):
    return I.documents(spark, folder).select("doc_id", T.split_punct("text").alias("split"))


@query(S.with_(S.DOC_TOKENS) + "SELECT doc_id, len(toks)::BIGINT AS n_tokens, array_to_string(toks, ' ') AS tokens FROM doc_tokens")
def basic_tokens(spark, folder):
    docs = I.documents(spark, folder).select("doc_id", T.basic_tokens("text").alias("toks"))
    return docs.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"), I.joined("toks").alias("tokens"))


KEPT = (
    f"flatten(list_transform({S.words(S.spaced(S.clean('joint')))}, "
    f"lambda w: CASE WHEN w = '[SEP]' THEN [w] ELSE {S.words(S.punct(S.folded('w'))).replace('lambda t: t', 'lambda u: u')} END))"
)
PAIR_TEXT = (
    f"(CASE WHEN {S.present('first')} THEN first ELSE '' END) || ' [SEP] ' || (CASE WHEN {S.present('second')} THEN second ELSE '' END)"
)


@query(S.with_(S.PAIRS) + f"SELECT pair_id, {S.joined(KEPT)} AS tokens FROM (SELECT pair_id, {PAIR_TEXT} AS joint FROM pairs)")
def basic_tokens_never_split(spark, folder):
    both = I.pairs(spark, folder).select("pair_id", T.pair_text("first", "second").alias("joint"))
    return both.select("pair_id", I.joined(T.basic_tokens("joint", never_split=["[SEP]"])).alias("tokens"))


@query(S.with_(S.PAIRS) + f"SELECT pair_id, {PAIR_TEXT} AS joint FROM pairs")
def pair_text(spark, folder):
    return I.pairs(spark, folder).select("pair_id", T.pair_text("first", "second").alias("joint"))


@query(S.with_(S.DOC_TOKENS, S.TERM_FREQ, S.PIECES) + "SELECT token, array_to_string(pieces, ' ') AS pieces, len(pieces)::INT AS n_pieces FROM pieced")
def wordpieces(spark, folder):
    freq = I.frequencies(spark, folder)
    found = P.wordpieces(freq, I.piece_table(spark, folder))
    return found.select("token", I.joined("pieces").alias("pieces"), "n_pieces")


IDS = "ids AS (SELECT token, (1000 + row_number() OVER (ORDER BY md5(token)))::INT AS id FROM tf WHERE freq >= 5)"
ENCODED = (
    "encoded AS (SELECT doc_id, string_agg(coalesce(id, 100)::VARCHAR, ' ' ORDER BY pos) AS ids, "
    "string_agg(coalesce(ids.token, '[UNK]'), ' ' ORDER BY pos) AS tokens FROM doc_rows LEFT JOIN ids USING (token) GROUP BY doc_id)"
)


def _ids(spark, folder):
    frequent = I.frequencies(spark, folder).where("freq >= 5").select("token")
    placed = numbered(frequent, [F.md5("token")], name="id")
    return settle(placed.select("token", (F.col("id") + 1000).cast("int").alias("id")), "ids")


def _encoded(spark, folder, vocab):
    docs = I.documents(spark, folder).select("doc_id", T.basic_tokens("text").alias("toks"))
    return P.encode_ids(docs, "doc_id", "toks", vocab, unk=100)


@query(S.with_(S.DOC_TOKENS, S.DOC_ROWS, S.TERM_FREQ, IDS, ENCODED) + "SELECT doc_id, coalesce(ids, '') AS ids FROM documents LEFT JOIN encoded USING (doc_id)")
def encode_ids(spark, folder):
    return _encoded(spark, folder, _ids(spark, folder)).select("doc_id", I.joined("ids").alias("ids"))


@query(S.with_(S.DOC_TOKENS, S.DOC_ROWS, S.TERM_FREQ, IDS, ENCODED) + "SELECT doc_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN encoded USING (doc_id)")
def decode_ids(spark, folder):
    vocab = _ids(spark, folder)
    ids = settle(_encoded(spark, folder, vocab), "encoded")
    return P.decode_ids(ids, "doc_id", "ids", vocab).select("doc_id", I.joined("tokens").alias("tokens"))


HALVES = "flatten(list_transform(toks, lambda t: CASE WHEN length(t) > 4 THEN [substr(t, 1, 4), '##' || substr(t, 5)] ELSE [t] END))"


@query(S.with_(S.DOC_TOKENS) + f"SELECT doc_id, trim(replace({S.joined(HALVES)}, ' ##', '')) AS text FROM doc_tokens")
def join_pieces(spark, folder):
    docs = I.documents(spark, folder).select("doc_id", T.basic_tokens("text").alias("toks"))
    rest = lambda t: F.concat(F.lit("##"), F.substring(t, F.lit(5), F.length(t)))
    halves = F.flatten(
        F.transform("toks", lambda t: F.when(F.length(t) > 4, F.array(F.substring(t, 1, 4), rest(t))).otherwise(F.array(t)))
    )
    return docs.select("doc_id", T.join_pieces(halves).alias("text"))


def _lengths(col):
    return F.transform(T.basic_tokens(col), lambda t: F.length(t))


def _input_columns(made):
    return [I.joined(col).alias(name) for name, col in made.items()]


def _padded(body: str, fill: str) -> str:
    return f"array_to_string(list_concat({body}, list_transform(range(0, 128 - n), lambda i: {fill})), ' ')"


@query(
    S.with_(S.DOC_TOKENS)
    + f"SELECT doc_id, {_padded('list_concat([101], a, [102])', '0')} AS input_ids, "
    + f"{_padded('list_transform(range(0, n), lambda i: 0)', '0')} AS token_type_ids, "
    + f"{_padded('list_transform(range(0, n), lambda i: CASE WHEN i = 0 OR i = n - 1 THEN 1 ELSE 0 END)', '1')} AS special_tokens_mask, "
    + f"{_padded('list_transform(range(0, n), lambda i: 1)', '0')} AS attention_mask "
    + "FROM (SELECT doc_id, a, len(a) + 2 AS n FROM (SELECT doc_id, list_transform(toks[1:126], lambda t: length(t)) AS a FROM doc_tokens))"
)
def build_inputs(spark, folder):
    made = P.build_inputs(F.col("a"))
    return I.documents(spark, folder).select("doc_id", _lengths("text").alias("a")).select("doc_id", *_input_columns(made))


@query(
    S.with_(S.PAIRS)
    + f"SELECT pair_id, {_padded('list_concat([101], a[1:ka], [102], b[1:kb], [102])', '0')} AS input_ids, "
    + f"{_padded('list_transform(range(0, n), lambda i: CASE WHEN i < ka + 2 THEN 0 ELSE 1 END)', '0')} AS token_type_ids, "
    + f"{_padded('list_transform(range(0, n), lambda i: CASE WHEN i = 0 OR i = ka + 1 OR i = n - 1 THEN 1 ELSE 0 END)', '1')} AS special_tokens_mask, "
    + f"{_padded('list_transform(range(0, n), lambda i: 1)', '0')} AS attention_mask "
    + "FROM (SELECT *, ka + kb + 3 AS n FROM (SELECT *, least(len(b), 125 - ka) AS kb FROM ("
    + "SELECT *, CASE WHEN len(b) <= 62 THEN least(len(a), 125 - len(b)) ELSE least(len(a), 63) END AS ka FROM ("
    + f"SELECT pair_id, list_transform({S.tok('first')}, lambda t: length(t)) AS a, list_transform({S.tok('second')}, lambda t: length(t)) AS b FROM pairs))))"
)
def build_pair_inputs(spark, folder):
    made = P.build_inputs(F.col("a"), F.col("b"))
    return (
        I.pairs(spark, folder)
        .select("pair_id", _lengths("first").alias("a"), _lengths("second").alias("b"))
        .select("pair_id", *_input_columns(made))
    )


def _aligned(rest: str) -> str:
    spread = f"flatten(list_transform(toks, lambda t: list_concat([length(t) % 3], list_transform(range(1, (length(t) + 3) // 4), lambda i: {rest}))))"
    body = f"list_concat([-100], ({spread})[1:126], [-100])"
    return f"array_to_string(list_concat({body}, list_transform(range(0, 128 - len({body})), lambda i: -100)), ' ')"


@query(S.with_(S.DOC_TOKENS) + f"SELECT doc_id, {_aligned('-100')} AS first_piece, {_aligned('length(t) % 3')} AS all_pieces FROM doc_tokens")
def align_labels(spark, folder):
    docs = I.documents(spark, folder).select("doc_id", _lengths("text").alias("n"))
    counts = F.transform("n", lambda n: F.floor((n + 3) / 4).cast("int"))
    tags = F.transform("n", lambda n: n % 3)
    return docs.select(
        "doc_id",
        I.joined(P.align_labels(counts, tags)).alias("first_piece"),
        I.joined(P.align_labels(counts, tags, all_tokens=True)).alias("all_pieces"),
    )


@query(
    S.with_(S.DOC_TOKENS, S.TERM_FREQ)
    + r"SELECT token, id FROM (SELECT token, 1000 + length(token) * 250 AS id FROM tf) WHERE id >= 1997 AND strlen(token) = length(token) "
    + r"AND NOT contains(token, '[unused') AND NOT regexp_matches(token, '\p{Nd}')"
)
def vocab_filter(spark, folder):
    vocab = I.frequencies(spark, folder).select("token", (1000 + F.length("token") * 250).cast("bigint").alias("id"))
    return vocab.where(T.vocab_filter("token", "id"))


CUT_PIECES = (
    "flat AS (SELECT doc_id, (flatten(list(pieces ORDER BY pos)))[1:126] AS body FROM doc_rows JOIN pieced USING (token) WHERE pos < 126 GROUP BY doc_id), "
    "lines AS (SELECT doc_id, list_concat(['[CLS]'], coalesce(body, []), ['[SEP]']) AS pieces FROM documents LEFT JOIN flat USING (doc_id) "
    r"WHERE regexp_matches(text, '[^\s\p{Z}]'))"
)


@query(
    S.with_(S.DOC_TOKENS, S.DOC_ROWS, S.TERM_FREQ, S.PIECES, CUT_PIECES)
    + "SELECT doc_id, array_to_string(pieces, ' ') AS pieces, array_to_string(list_transform(range(0, len(pieces)), "
    + "lambda i: CASE WHEN i = 0 OR i = len(pieces) - 1 THEN 1 ELSE 0 END), ' ') AS special_tokens_mask FROM lines"
)
def mlm_rows(spark, folder):
    made = _mlm(spark, folder)
    return made.select("doc_id", I.joined("pieces").alias("pieces"), I.joined("special_tokens_mask").alias("special_tokens_mask"))


def _mlm(spark, folder):
    freq = I.frequencies(spark, folder)
    found = settle(P.wordpieces(freq, I.piece_table(spark, folder)).join(freq, "token"), "pieced")
    return P.mlm_rows(I.documents(spark, folder), "doc_id", "text", found)


MASK_KEY = ("doc_id", "i")
CHOSEN = f"(i > 0 AND i < n - 1 AND {S.unit(42, *MASK_KEY)} < 0.15)"
HOW = S.unit("42|how", *MASK_KEY)


@query(
    S.with_(
        S.DOC_TOKENS,
        S.DOC_ROWS,
        S.TERM_FREQ,
        S.PIECES,
        CUT_PIECES,
        "cells AS (SELECT doc_id, len(pieces) AS n, unnest(list_transform(pieces, lambda p: length(p))) AS id, generate_subscripts(pieces, 1) - 1 AS i FROM lines)",
    )
    + f"SELECT doc_id, string_agg((CASE WHEN {CHOSEN} AND {HOW} < 0.8 THEN 103 WHEN {CHOSEN} AND {HOW} < 0.9 "
    + f"THEN {S.integer('42|id', *MASK_KEY)} % 30000 ELSE id END)::VARCHAR, ' ' ORDER BY i) AS input_ids, "
    + f"string_agg((CASE WHEN {CHOSEN} THEN id ELSE -100 END)::VARCHAR, ' ' ORDER BY i) AS labels FROM cells GROUP BY doc_id"
)
def mask_tokens(spark, folder):
    rows = _mlm(spark, folder).withColumn("ids", F.transform("pieces", lambda p: F.length(p)))
    made = P.mask_tokens(rows, "doc_id", mask_id=103, vocab_size=30000)
    return made.select("doc_id", I.joined("input_ids").alias("input_ids"), I.joined("labels").alias("labels"))


LETTERS = [chr(c) for c in range(ord("a"), ord("z") + 1)]


@query(
    "SELECT token, "
    + ", ".join(f"(length(token) - length(replace(token, '{c}', '')))::INT AS n_{c}, (length(token) - length(replace(token, '{c.upper()}', '')))::INT AS n_upper_{c}" for c in LETTERS)
    + r" FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda t: t <> '')) AS token FROM documents)"
)
def letter_counts(spark, folder):
    words = F.array_remove(F.split("text", r"[ \t\n\r]+"), "")
    tokens = I.documents(spark, folder).select(F.explode_outer(F.array_distinct(words)).alias("token")).where("token is not null").distinct()
    return tokens.select("token", *[col.alias(name) for name, col in T.letter_counts("token").items()])


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes FROM documents")
def utf8_length(spark, folder):
    return I.documents(spark, folder).select("doc_id", T.utf8_length("text").cast("bigint").alias("bytes"))


@query(f"SELECT p_partkey, round({S.norm_lev('p_name', 'p_type')}, 6) AS dist FROM part")
def norm_lev(spark, folder):
    part = spark.read.parquet(f"{folder}/part.parquet")
    return part.select("p_partkey", F.round(T.norm_lev("p_name", "p_type"), 6).alias("dist"))
