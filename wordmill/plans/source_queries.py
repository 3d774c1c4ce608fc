"""Queries over readers and writers: the tables travel through each format and come back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.functions import fixed
from wordmill.operators import swap as W
from wordmill.operators.scale import new_path, settle
from wordmill.plans import inputs as I
from wordmill.plans import sql as S
from wordmill.plans.registry import query
from wordmill.session import load
from wordmill.sources import readers, writers

TEXT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)


@query(S.with_(S.SPLITS) + "SELECT doc_id, text, lang AS label, source, split FROM split_docs")
def read_splits(spark, folder):
    path = new_path(spark, "splits")
    docs = I.split_documents(spark, folder).withColumn("label", F.col("lang"))
    writers.write_splits(docs, path, [f.name for f in TEXT_SCHEMA])
    return readers.read_splits(spark, path, TEXT_SCHEMA)


@query(S.with_(S.DOC_TOKENS) + "SELECT doc_id, to_json(toks)::VARCHAR AS tokens, 'a' AS part FROM doc_tokens UNION ALL SELECT doc_id, to_json(list_reverse(toks))::VARCHAR, 'b' FROM doc_tokens")
def write_tsv(spark, folder):
    """Two datasets with an array column, joined into one shuffled file set."""
    path = new_path(spark, "tsv") + ".tsv"
    docs = I.documents(spark, folder).select("doc_id", I.tokens().alias("tokens"), F.lit("a").alias("part"))
    back = docs.select("doc_id", F.reverse("tokens").alias("tokens"), F.lit("b").alias("part"))
    writers.write_tsv(docs, back, path=path, cols=["doc_id", "tokens", "part"])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.StringType()), T.StructField("part", T.StringType())])
    return readers.read_any(spark, path, schema)


STARS = "1 + doc_id % 6"


def _reviews(spark, folder):
    path = new_path(spark, "reviews") + ".csv"
    docs = I.documents(spark, folder).orderBy("doc_id")
    docs.select((F.col("doc_id") % 6 + 1).alias("c0"), "lang", "text").write.csv(path, **writers.WRITE_OPTIONS)
    return path


@query(f"SELECT text, CASE {STARS} WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS label FROM documents WHERE {STARS} <= 5")
def read_reviews(spark, folder):
    return readers.read_reviews(spark, _reviews(spark, folder), 3).select("text", "label")


@query(
    f"SELECT text, 2 AS label FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents) WHERE line >= 100 AND line < 700 AND {STARS} = 3"
)
def read_reviews_range(spark, folder):
    rows = readers.read_reviews(
        spark, _reviews(spark, folder), 3, label_map=fixed.NEUTRAL_STAR_LABELS, line_range=(100, 700)
    )
    return rows.select("text", "label")


@query(
    f"SELECT text, label FROM (SELECT text, label, row_number() OVER (ORDER BY {S.key(42, 'text', 'label')}, text, label) AS rn FROM "
    f"(SELECT text, CASE {STARS} WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS label FROM documents WHERE {STARS} <= 5)) WHERE rn <= 300"
)
def read_reviews_sample(spark, folder):
    return readers.read_reviews(spark, _reviews(spark, folder), 3, sample_size=300).select("text", "label")


@query(
    S.with_(S.LABELLED)
    + r"SELECT line AS text, quality AS label FROM (SELECT unnest(string_split(text, chr(10))) AS line, quality FROM labelled) WHERE regexp_matches(line, '[^\s\p{Z}]')"
)
def read_polarity_lines(spark, folder):
    path = new_path(spark, "polarity")
    docs = I.labelled(spark, folder)
    for name, label in (("pos", 1), ("neg", 0)):
        docs.where(F.col("quality") == label).select("text").write.text(f"{path}/custrev.{name}")
    return readers.read_polarity_lines(spark, path).select("text", "label")


@query(S.with_(S.LABELLED) + "SELECT text || chr(10) AS text, quality AS label FROM labelled")
def read_polarity_dirs(spark, folder):
    path = new_path(spark, "polarity")
    docs = I.labelled(spark, folder)
    for name, label in (("pos", 1), ("neg", 0)):
        part = docs.where(F.col("quality") == label).select("text")
        # one file for each text; tasks move their own, so the driver does not move all of them one by one
        part.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(f"{path}/{name}")
    return readers.read_polarity_dirs(spark, path).select("text", "label")


def _annotated(spark, folder):
    """Documents as annotated sentences: two workers vote, the language tells how."""
    gold = F.when(F.col("lang") == "en", "positive").when(F.col("lang") == "de", "negative").when(F.col("lang") == "fr", "neutral").otherwise("mixed")
    workers = F.array(F.concat(F.lit("w"), F.col("doc_id") % 5), F.concat(F.lit("v"), F.col("doc_id") % 3))
    return I.documents(spark, folder).select(
        F.col("text").alias("sentence"), gold.alias("gold_label"), F.create_map(gold, workers).alias("label_distribution")
    )


GOLD = "CASE lang WHEN 'en' THEN 'positive' WHEN 'de' THEN 'negative' WHEN 'fr' THEN 'neutral' ELSE 'mixed' END"


def _jsonl(spark, folder):
    path = new_path(spark, "annotated") + ".jsonl"
    _annotated(spark, folder).write.json(path)
    return path


@query("SELECT text, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 0 ELSE 2 END AS label FROM documents WHERE lang IN ('en', 'de', 'fr')")
def read_jsonl_gold(spark, folder):
    return readers.read_jsonl_gold(spark, _jsonl(spark, folder))


@query(
    f"WITH votes AS (SELECT text, {GOLD} AS vote, unnest(['w' || doc_id % 5, 'v' || doc_id % 3]) AS worker FROM documents) "
    "SELECT text, CASE vote WHEN 'positive' THEN 1 WHEN 'mixed' THEN 1 WHEN 'negative' THEN 0 ELSE 2 END AS label, worker FROM votes "
    "UNION ALL SELECT text, 0, worker FROM votes WHERE vote = 'mixed'"
)
def explode_label_distribution(spark, folder):
    return readers.explode_label_distribution(readers.read_jsonl(spark, _jsonl(spark, folder)))


def _trees(spark, folder):
    """One tree per conversation turn: the words are leaves, each half of them is a subtree."""
    words = F.filter(I.tokens(), lambda t: ~t.isin("(", ")"))
    leaf = lambda t: F.concat(F.lit("("), (F.length(t) % 6).cast("string"), F.lit(" "), t, F.lit(")"))
    leaves = F.transform("words", leaf)
    half = F.ceil(F.size("words") / 2).cast("int")
    line = F.concat(
        F.lit("(2 (1 "),
        F.array_join(F.slice(leaves, F.lit(1), half), " "),
        F.lit(") (3 "),
        F.array_join(F.slice(leaves, half + 1, F.size("words")), " "),
        F.lit("))"),
    )
    talk = load(spark, folder, "conversations")
    return (
        talk.select((F.col("conv_id") * 100000 + F.col("turn")).alias("tree_id"), words.alias("words"))
        .where(F.size("words") >= 2)
        .select("tree_id", line.alias("line"))
    )


TREES = (
    f"trees AS (SELECT * FROM (SELECT conv_id * 100000 + turn AS tree_id, list_filter({S.tok('text')}, lambda w: w NOT IN ('(', ')')) AS words FROM conversations) WHERE len(words) >= 2)",
    "halves AS (SELECT *, (len(words) + 1) // 2 AS h FROM trees)",
    "nodes AS (SELECT tree_id, array_to_string(words, ' ') AS text, '2' AS tag FROM halves "
    "UNION ALL SELECT tree_id, array_to_string(words[1:h], ' '), '1' FROM halves UNION ALL SELECT tree_id, array_to_string(words[h + 1:], ' '), '3' FROM halves "
    "UNION ALL SELECT tree_id, w, (length(w) % 6)::VARCHAR FROM (SELECT tree_id, unnest(words) AS w FROM trees))",
)
TREE_LABEL = "CASE tag WHEN '0' THEN 0 WHEN '1' THEN 0 WHEN '2' THEN 2 WHEN '3' THEN 1 WHEN '4' THEN 1 ELSE -1 END"


@query(S.with_(*TREES) + f"SELECT tree_id, text, {TREE_LABEL} AS label FROM nodes")
def tree_spans(spark, folder):
    spans = readers.tree_spans(_trees(spark, folder), "tree_id", "line")
    return spans.select("tree_id", "text", F.coalesce("label", F.lit(-1)).alias("label"))


@query(S.with_(*TREES) + "SELECT tree_id, array_to_string(words, ' ') AS text, 2 AS label FROM trees")
def tree_roots(spark, folder):
    spans = readers.tree_spans(
        _trees(spark, folder), "tree_id", "line", include_subtrees=False, classes=fixed.NEUTRAL_TREE_LABELS
    )
    return spans.select("tree_id", "text", "label")


@query(S.with_(S.DOC_TOKENS, S.DOC_FREQ) + "SELECT token, (row_number() OVER (ORDER BY freq DESC, md5(token)) - 1)::INT AS id FROM df")
def read_vocab(spark, folder):
    """Vocabulary written in id order and read back by line number."""
    ranked = W.freq_rank(I.field_frequencies(spark, folder))
    path = new_path(spark, "vocab") + ".txt"
    writers.write_vocab(settle(ranked.select("token", (F.col("rank") - 1).alias("id")), "vocab"), path)
    return readers.read_vocab(spark, path)


@query(S.with_(S.SPLITS) + "SELECT doc_id, n_chars, split FROM split_docs")
def save_splits(spark, folder):
    path = new_path(spark, "dataset")
    writers.save_splits(I.split_documents(spark, folder).select("doc_id", "text", "n_chars", "split"), path)
    return readers.load_splits(spark, path).select("doc_id", "n_chars", "split")


@query(S.with_(S.DOC_TOKENS, S.DOC_FREQ, S.VOCAB, S.swap_rank("vocab")) + "SELECT src, dst FROM swaps")
def save_map(spark, folder):
    path = new_path(spark, "map")
    writers.save_map(W.swap_rank(I.vocabulary(spark, folder)), path)
    return readers.load_map(spark, path)


RESULT_SQL = (
    "SELECT 'cola' AS glue_task, 'eval' AS split, lang AS model, '2e-05' AS learning_rate, lang AS tokenizer, 'true' AS midtuning, 'null' AS galactic_shift, "
    "'false' AS reinit_embedding, 'false' AS reverse_order, 'false' AS random_order, 'false' AS token_swap, 'false' AS word_swap, 'false' AS word_swap_frequency, "
    "'{metric}' AS metrics, {value} AS performance FROM documents GROUP BY lang"
)


@query(RESULT_SQL.format(metric="n", value="count(*)::VARCHAR") + " UNION ALL " + RESULT_SQL.format(metric="longest", value="max(n_chars)::VARCHAR"))
def append_results(spark, folder):
    """Two rounds of result rows, appended to one table."""
    path = new_path(spark, "results") + ".csv"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for metric, value in (("n", F.count("*")), ("longest", F.max("n_chars"))):
        rows = docs.groupBy("lang").agg(value.cast("string").alias("performance"))
        constants = {
            "glue_task": "cola", "split": "eval", "learning_rate": "2e-05", "midtuning": "true", "galactic_shift": "null",
            "reinit_embedding": "false", "reverse_order": "false", "random_order": "false", "token_swap": "false",
            "word_swap": "false", "word_swap_frequency": "false", "metrics": metric,
        }
        filled = rows.select(F.col("lang").alias("model"), F.col("lang").alias("tokenizer"), "performance", *[F.lit(v).alias(c) for c, v in constants.items()])
        writers.append_results(filled, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in fixed.RESULT_COLUMNS])
    return readers.read_any(spark, path, schema)


@query("SELECT doc_id AS index, CASE WHEN n_chars % 3 = 0 THEN 'negative' WHEN n_chars % 3 = 1 THEN 'positive' ELSE 'neutral' END AS prediction FROM documents")
def export_predictions(spark, folder):
    path = new_path(spark, "predictions") + ".tsv"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", (F.col("n_chars") % 3).cast("int").alias("pred"))
    writers.export_predictions(docs, path, {0: "negative", 1: "positive", 2: "neutral"}, index="doc_id")
    schema = T.StructType([T.StructField("index", T.LongType()), T.StructField("prediction", T.StringType())])
    return readers.read_any(spark, path, schema)


@query("SELECT doc_id AS index, printf('%.3f', n_chars / 7.0::DOUBLE) AS prediction FROM documents")
def export_scores(spark, folder):
    path = new_path(spark, "predictions") + ".tsv"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", (F.col("n_chars") / 7.0).alias("pred"))
    writers.export_predictions(docs, path, None, index="doc_id")
    schema = T.StructType([T.StructField("index", T.LongType()), T.StructField("prediction", T.StringType())])
    return readers.read_any(spark, path, schema)


@query("SELECT doc_id, text, lang FROM documents")
def read_any(spark, folder):
    """Documents through a JSON file set and then a CSV file set, told apart by their extensions."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    json_path, csv_path = new_path(spark, "any") + ".json", new_path(spark, "any") + ".csv"
    I.documents(spark, folder).select("doc_id", "text", "lang").write.json(json_path)
    readers.read_any(spark, json_path, schema).write.csv(csv_path, header=True, **writers.WRITE_OPTIONS)
    return readers.read_any(spark, csv_path, schema)
