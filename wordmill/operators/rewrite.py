"""Rewriting datasets: word substitution, reordering, sampling and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.functions import fixed
from wordmill.functions.hashing import hash_key
from wordmill.functions.text import basic_tokens, is_present, join_pieces, scramble_window, shuffle_words
from wordmill.operators.scale import gather_by_token, mark_first, numbered, settle, take_first


def _replace_tokens(
    docs: DataFrame, key: str, fields: int, mapping: DataFrame, strict: bool
) -> DataFrame:
    """Substitute tokens of the arrays ``t0, t1, ...``: ``(key, items, raw0, raw1, ...)``.

    ``docs`` arrives partitioned by ``key``, with compact rows. Unnesting, a broadcast lookup and the
    regrouping keep that partitioning, so the exploded tokens are not shuffled when the map is small
    enough to broadcast; of a larger map only the tokens with rare words are. A field without tokens travels as
    one item that only carries its ``raw`` value.
    """
    items = F.concat(*[_tagged(i) for i in range(fields)])
    rows = docs.select(key, F.explode_outer(items).alias("t")).select(
        key, "t.field", "t.pos", "t.token", "t.raw"
    )
    word = F.coalesce("dst", "token")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no replacement for token "), F.col("token")))
        lost = F.col("dst").isNull() & F.col("token").isNotNull()
        word = F.when(lost, missing.cast("string")).otherwise(F.col("dst"))
    placed = F.when(F.col("pos") >= 0, F.struct("field", "pos", word.alias("w")))
    raws = [F.max(F.when(F.col("field") == i, F.col("raw"))).alias(f"raw{i}") for i in range(fields)]
    return gather_by_token(rows, mapping.withColumnRenamed("src", "token"), key, placed, raws)


def _tagged(i: int) -> Column:
    """Items of one field: its tokens with their positions, or a single one with the raw value."""
    tokens = F.transform(
        f"t{i}",
        lambda t, pos: F.struct(
            F.lit(i).alias("field"), pos.alias("pos"), t.alias("token"), F.lit(None).cast("string").alias("raw")
        ),
    )
    bare = F.struct(
        F.lit(i).alias("field"),
        F.lit(-1).alias("pos"),
        F.lit(None).cast("string").alias("token"),
        F.col(f"raw{i}").alias("raw"),
    )
    return F.when(F.size(f"t{i}") > 0, tokens).otherwise(F.array(bare))


def _words_of(i: int) -> Column:
    return F.transform(F.filter("items", lambda x: x["field"] == i), lambda x: x["w"])


def _with_other_columns(df: DataFrame, key: str, changed: DataFrame, cols: list[str]) -> DataFrame:
    """Put the untouched columns next to the rewritten ones; the texts themselves do not travel again."""
    rest = [c for c in df.columns if c not in cols and c != key]
    table = df.select(key, *rest).join(changed, key) if rest else changed
    return table.select(*df.columns)


def apply_swap(df: DataFrame, key: str, cols: list[str], mapping: DataFrame) -> DataFrame:
    """Tokenise the text columns, replace every mapped word once, and join the words again.

    Empty texts stay as they are. All other columns are kept. ``key`` identifies the rows.
    """
    docs = df.select(key, *cols).repartition(key)
    fields = [
        col
        for i, c in enumerate(cols)
        for col in (
            F.when(is_present(c), basic_tokens(c)).alias(f"t{i}"),
            F.when(is_present(c), F.lit("")).otherwise(F.col(c)).alias(f"raw{i}"),
        )
    ]
    swapped = _replace_tokens(docs.select(key, *fields), key, len(cols), mapping, strict=False)
    texts = [
        F.when(F.exists("items", lambda x: x["field"] == i), join_pieces(_words_of(i))).otherwise(F.col(f"raw{i}")).alias(c)
        for i, c in enumerate(cols)
    ]
    return _with_other_columns(df, key, swapped.select(key, *texts), cols)


def apply_swap_tokens(
    df: DataFrame, key: str, col: str, mapping: DataFrame, strict: bool = True
) -> DataFrame:
    """Replace the tokens of an array column; in strict mode a token without a replacement is an error."""
    docs = df.repartition(key).select(
        key, F.col(col).alias("t0"), F.when(F.col(col).isNotNull(), F.lit("empty")).alias("raw0")
    )
    swapped = _replace_tokens(docs, key, 1, mapping, strict)
    words = _words_of(0)
    absent = (F.size("items") == 0) & F.col("raw0").isNull()
    changed = swapped.select(key, F.when(~absent, words).alias(col))
    return _with_other_columns(df, key, changed, [col])


def scramble_windows(df: DataFrame, key: str, cols: list[str], proportion: float, seed: int) -> DataFrame:
    """Shuffle a contiguous share of the words of each text column; an absent text becomes empty."""
    return df.withColumns(
        {
            c: join_pieces(
                scramble_window(
                    F.coalesce(basic_tokens(c), F.array().cast("array<string>")),
                    F.concat_ws("|", F.lit(c), F.col(key)),
                    proportion,
                    seed,
                )
            )
            for c in cols
        }
    )


def sample_exact(
    df: DataFrame, key: str, seed: int, frac: float | None = None, n: int | None = None
) -> DataFrame:
    """Seeded sample of exactly ``n`` rows, or of ``int(rows * frac)``, without replacement."""
    if n is None:
        n = int(df.count() * frac)
    return take_first(df, hash_key(seed, key), [key], n)


def split_exact(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Random split of exact sizes: ``int(rows * share)`` rows are train, the rest dev."""
    marked = mark_first(df, hash_key(seed, key), [key], int(df.count() * share))
    return marked.withColumn("part", F.when(F.col("taken"), "train").otherwise("dev")).drop("taken")


def cap_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows in key order. Only the keys are sorted; the rows are cut by comparison."""
    last = numbered(df.select(key), [F.col(key)], name="_place").where(F.col("_place") <= n)
    return df.where(F.col(key) <= last.agg(F.max(key)).scalar())


def preview(df: DataFrame, key: str, col: str, mapping: DataFrame, n: int, seed: int) -> DataFrame:
    """Original, swapped, and swapped plus reordered text of ``n`` random rows, side by side."""
    chosen = settle(sample_exact(df.select(key, col), key, seed, n=n), "preview")
    swapped = apply_swap(chosen.withColumn("swapped", F.col(col)), key, ["swapped"], mapping)
    return swapped.select(
        key, F.col(col).alias("original"), "swapped", shuffle_words("swapped", key, seed).alias("reordered")
    )


def dedup_text(df: DataFrame, text: str, row: str, keep: list[str]) -> DataFrame:
    """One row per distinct text; the last row wins (pre-aggregated before the shuffle)."""
    last = df.groupBy(text).agg(F.max_by(F.struct(*keep), row).alias("last"))
    return last.select(text, *[F.col(f"last.{c}").alias(c) for c in keep])


def by_source(df: DataFrame, source: str = "all") -> DataFrame:
    """Rows of one source; ``all`` keeps everything."""
    return df if source == "all" else df.where(F.col("source") == source)


def downsample_min(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """As many random rows of every label as the rarest label has."""
    smallest = df.groupBy(label).count().agg(F.min("count")).first()[0]
    return take_first(df, hash_key(seed, key), [key], smallest, [label])


def training_view(df: DataFrame, task: str) -> DataFrame:
    """Text columns of a task and its label (the tag column for tagging tasks)."""
    fields = [f for f in fixed.TASK_FIELDS[task] if f]
    return df.select(*fields, F.col(fixed.TAG_COLUMNS.get(task, "label")).alias("label"))


def map_labels(df: DataFrame, col: str, ids: dict) -> DataFrame:
    """Labels to ids by a dictionary; -1 (unlabelled) is kept."""
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    unlabelled = F.col(col).cast("string") == "-1"
    return df.withColumn(col, F.when(unlabelled, F.lit(-1)).otherwise(F.element_at(table, F.col(col))))
