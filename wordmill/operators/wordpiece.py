"""Word pieces, ids and model inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.functions import fixed
from wordmill.functions.arrays import unnest_with_position
from wordmill.functions.hashing import hash_int, hash_unit
from wordmill.functions.text import basic_tokens
from wordmill.operators.scale import gather_by_token, is_small, settle, task_count
from wordmill.operators.vocab import term_freq

MAX_WORD = 100
#: Pieces that a word asks for in one round, unless a single start has more lengths.
PER_ROUND = 64


def wordpieces(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Greedy longest-match pieces of every distinct word: ``(token, pieces, n_pieces)``.

    Rounds over the words that are not yet through: each word asks for the pieces that could begin at the next few
    starts from where it has arrived, of those lengths alone that the vocabulary has, and for about ``PER_ROUND`` at
    most. The longest hit of each start survives and the word follows the chain. A word with a gap leaves the rounds;
    it and any word longer than 100 characters become the unknown piece.
    """
    spark = words.sparkSession
    spread = task_count(spark)
    words = words.select("token").repartition(spread, "token").distinct()
    n = F.length("token")
    heads, tails = _piece_lengths(vocab)
    known = vocab.select(F.col("token").alias("piece"))
    known = F.broadcast(known) if is_small(vocab) else known
    front = words.where(n.between(1, MAX_WORD)).select("token", F.lit(1).alias("at"))
    starts = 1 + max(0, PER_ROUND - len(heads)) // max(1, len(tails))
    rounds = []
    while True:
        hits = piece_candidates(front, heads, tails, starts).join(known, "piece", "left_semi")
        rounds.append(settle(_advance(hits, starts), "pieces"))
        going = rounds[-1].where((F.col("c.at") >= F.col("at") + starts) & (F.col("c.at") <= n))
        if not tails or going.isEmpty():
            break
        front = going.select("token", "c.at").repartition(spread, "token")
        starts = max(1, PER_ROUND // len(tails))
    if len(rounds) == 1:
        found = rounds[0].select("token", "c.ends", "c.at")
    else:
        parts = reduce(DataFrame.unionByName, [r.select("token", "c.ends", "c.at") for r in rounds])
        found = parts.groupBy("token").agg(F.array_sort(F.flatten(F.collect_list("ends"))).alias("ends"), F.max("at").alias("at"))
    found = found.where(F.col("at") == n + 1).select("token", "ends")
    cut = lambda end, i: F.concat(
        F.when(i == 0, "").otherwise("##"),
        F.substring(F.col("token"), F.when(i == 0, 1).otherwise(F.get("ends", i - 1)), end - F.when(i == 0, 1).otherwise(F.get("ends", i - 1))),
    )
    pieces = F.when(F.col("ends").isNull(), F.array(F.lit(fixed.UNK))).otherwise(F.transform("ends", cut))
    return words.join(found, "token", "left").select("token", pieces.alias("pieces")).withColumn("n_pieces", F.size("pieces"))


def _piece_lengths(vocab: DataFrame) -> tuple[list[int], list[int]]:
    """Lengths of head and of continuation pieces that a vocabulary has, longest first, at most ``MAX_WORD`` of each."""
    n = F.length("token")
    tail = F.when(F.col("token").startswith("##"), n - 2)
    sizes = lambda size: F.sort_array(F.collect_set(F.when(size.between(1, MAX_WORD), size)), asc=False)
    row = vocab.agg(sizes(n).alias("heads"), sizes(tail).alias("tails")).first()
    return row["heads"], row["tails"]


def piece_candidates(front: DataFrame, heads: list[int], tails: list[int], starts: int) -> DataFrame:
    """The pieces of the given lengths that could begin at the next few starts of words that have arrived ``at`` a place."""
    n = F.length("token")
    sizes = lambda lengths: F.array(*[F.lit(size) for size in lengths]).cast("array<int>")

    def from_start(s: Column) -> Column:
        return F.transform(
            F.filter(F.when(s == 1, sizes(heads)).otherwise(sizes(tails)), lambda size: s + size <= n + 1),
            lambda size: F.struct(
                s.alias("s"),
                (s + size).alias("nxt"),
                F.concat(F.when(s == 1, "").otherwise("##"), F.substring(F.col("token"), s, size)).alias("piece"),
            ),
        )

    spans = F.flatten(F.transform(F.sequence("at", F.least(F.col("at") + (starts - 1), n)), from_start))
    return front.select("token", "at", F.explode_outer(spans).alias("c")).select("token", "at", "c.*")


def _advance(hits: DataFrame, starts: int) -> DataFrame:
    """Words with the place that they reach by their longest hits and the piece ends on the way, ``c``; words without a hit are gone."""
    steps = (
        hits.groupBy("token", "s")
        .agg(F.max("nxt").alias("nxt"), F.min("at").alias("at"))
        .groupBy("token")
        .agg(F.map_from_entries(F.collect_list(F.struct("s", "nxt"))).alias("steps"), F.min("at").alias("at"))
    )

    def follow(acc: Column, s: Column) -> Column:
        nxt = F.element_at("steps", s)
        on = (acc["at"] == s) & nxt.isNotNull()
        return F.struct(
            F.when(on, nxt).otherwise(acc["at"]).alias("at"),
            F.when(on, F.array_append(acc["ends"], nxt)).otherwise(acc["ends"]).alias("ends"),
        )

    start = F.struct(F.col("at").alias("at"), F.array().cast("array<int>").alias("ends"))
    last = F.least(F.col("at") + (starts - 1), F.length("token"))
    chain = F.aggregate(F.sequence(F.col("at"), last), start, follow)
    return steps.select("token", "at", chain.alias("c"))


def vocab_table(freq: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """Vocabulary with frequency and piece count; without pieces every token counts as one piece."""
    if pieces is None:
        return freq.select("token", "freq", F.lit(1).alias("n_pieces"))
    return freq.join(pieces.select("token", "n_pieces"), "token").select("token", "freq", "n_pieces")


def encode_ids(df: DataFrame, key: str, col: str, vocab: DataFrame, unk: int) -> DataFrame:
    """Token arrays to id arrays, unknown tokens to ``unk``; an empty array stays empty."""
    docs = df.select(key, col).repartition(key)
    rows = unnest_with_position(docs, [key], F.col(col))
    return _regroup(docs, rows, _ids(vocab), "token", key, F.coalesce("id", F.lit(unk)), "ids")


def decode_ids(df: DataFrame, key: str, col: str, vocab: DataFrame) -> DataFrame:
    """Id arrays back to token arrays, unknown ids to the unknown piece."""
    docs = df.select(key, col).repartition(key)
    rows = unnest_with_position(docs, [key], F.col(col), "id")
    return _regroup(docs, rows, _ids(vocab), "id", key, F.coalesce("token", F.lit(fixed.UNK)), "tokens")


def _ids(vocab: DataFrame) -> DataFrame:
    """Tokens and ids of a vocabulary, with their frequency if it is known."""
    return vocab.select("token", "id", *[c for c in ("freq",) if c in vocab.columns])


def _regroup(docs: DataFrame, rows: DataFrame, table: DataFrame, on: str, key: str, value: Column, name: str) -> DataFrame:
    """Values of all positions, looked up and put back into one array per row. Both sides keep the partitioning by ``key``."""
    lists = gather_by_token(rows, table, key, F.struct(F.col("pos"), value.alias("v")), on=on)
    empty = F.array().cast(lists.select("items.v").schema["v"].dataType)
    return docs.select(key).join(lists, key, "left").select(
        key, F.coalesce(F.col("items.v"), empty).alias(name)
    )


def build_inputs(
    first: Column, second: Column | None = None, max_len: int = 128, cls: int = 101, sep: int = 102, pad: int = 0
) -> dict[str, Column]:
    """Model input of one or two id arrays: ids, segment ids, special and attention masks, padded.

    Pairs that are too long lose ids from the end of the longer side first, of the second one at a tie.
    """
    if second is None:
        a = F.slice(first, 1, max_len - 2)
        body = F.concat(F.array(F.lit(cls)), a, F.array(F.lit(sep)))
        types = F.array_repeat(F.lit(0), F.size(body))
        special = F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), F.size(a)), F.array(F.lit(1)))
    else:
        room = max_len - 3
        n_a, n_b = F.size(first), F.size(second)
        keep_a = F.when(n_b <= room // 2, F.least(n_a, room - n_b)).otherwise(
            F.least(n_a, F.lit((room + 1) // 2))
        )
        keep_b = F.least(n_b, room - keep_a)
        a, b = F.slice(first, F.lit(1), keep_a), F.slice(second, F.lit(1), keep_b)
        body = F.concat(F.array(F.lit(cls)), a, F.array(F.lit(sep)), b, F.array(F.lit(sep)))
        types = F.concat(
            F.array_repeat(F.lit(0), F.size(a) + 2), F.array_repeat(F.lit(1), F.size(b) + 1)
        )
        special = F.concat(
            F.array(F.lit(1)),
            F.array_repeat(F.lit(0), F.size(a)),
            F.array(F.lit(1)),
            F.array_repeat(F.lit(0), F.size(b)),
            F.array(F.lit(1)),
        )
    fill = F.lit(max_len) - F.size(body)
    return {
        "input_ids": F.concat(body, F.array_repeat(F.lit(pad), fill)),
        "token_type_ids": F.concat(types, F.array_repeat(F.lit(0), fill)),
        "special_tokens_mask": F.concat(special, F.array_repeat(F.lit(1), fill)),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size(body)), F.array_repeat(F.lit(0), fill)),
    }


def align_labels(piece_counts: Column, labels: Column, all_tokens: bool = False, max_len: int = 128) -> Column:
    """Word labels spread over the pieces of each word, -100 on the rest and on the special positions."""
    rest = (lambda label: label) if all_tokens else (lambda label: F.lit(-100))
    spread = F.flatten(
        F.zip_with(
            piece_counts,
            labels,
            lambda n, label: F.concat(F.array(label), F.array_repeat(rest(label), n - 1)),
        )
    )
    body = F.concat(F.array(F.lit(-100)), F.slice(spread, 1, max_len - 2), F.array(F.lit(-100)))
    return F.concat(body, F.array_repeat(F.lit(-100), F.lit(max_len) - F.size(body)))


def mlm_rows(df: DataFrame, key: str, col: str, pieces: DataFrame, max_len: int = 128) -> DataFrame:
    """Word pieces of every non-blank line, cut to the model length, with the special-position mask."""
    docs = df.where(is_present_line(col)).select(key, F.slice(basic_tokens(col), 1, max_len - 2).alias("words")).repartition(key)
    words = unnest_with_position(docs, [key], F.col("words"))
    known = pieces.select("token", "pieces", *[c for c in ("freq",) if c in pieces.columns])
    lists = gather_by_token(words, known, key, F.struct("pos", "pieces"))
    flat = F.slice(F.flatten(F.col("items.pieces")), 1, max_len - 2)
    body = F.concat(F.array(F.lit(fixed.CLS)), flat, F.array(F.lit(fixed.SEP)))
    return (
        docs.select(key)
        .join(lists, key, "left")
        .select(key, F.coalesce(body, F.array(F.lit(fixed.CLS), F.lit(fixed.SEP))).alias("pieces"))
        .withColumn(
            "special_tokens_mask",
            F.transform("pieces", lambda p, i: ((i == 0) | (i == F.size("pieces") - 1)).cast("int")),
        )
    )


def is_present_line(col: str) -> Column:
    """A line with at least one character that is not white space."""
    return F.col(col).rlike(r"[^\s\p{Z}]")


def mask_tokens(
    df: DataFrame, key: str, mask_id: int, vocab_size: int, p: float = 0.15, seed: int = 42
) -> DataFrame:
    """Masked-language-model rows from ``ids`` and ``special_tokens_mask``.

    Ordinary positions are chosen by hash with probability ``p`` and keep their id as label (-100
    elsewhere); of the chosen, 80% become the mask id, 10% a random id and 10% stay.
    """
    chosen = lambda i: (F.col("special_tokens_mask")[i] == 0) & (hash_unit(seed, key, i) < p)
    how = lambda i: hash_unit(f"{seed}|how", key, i)
    other = lambda i: (hash_int(f"{seed}|id", key, i) % vocab_size).cast("int")
    changed = lambda t, i: (
        F.when(chosen(i) & (how(i) < 0.8), F.lit(mask_id))
        .when(chosen(i) & (how(i) < 0.9), other(i))
        .otherwise(t)
    )
    return df.select(
        key,
        F.transform("ids", changed).alias("input_ids"),
        F.transform("ids", lambda t, i: F.when(chosen(i), t).otherwise(F.lit(-100))).alias("labels"),
    )


def piece_vocabulary(df: DataFrame, col: str, min_freq: int = 5) -> DataFrame:
    """Small word-piece vocabulary of a corpus: frequent words, all characters, all continuation characters."""
    return pieces_of(settle(term_freq(df, col), "freq"), min_freq)


def pieces_of(freq: DataFrame, min_freq: int = 5) -> DataFrame:
    """The same from settled occurrence counts."""
    chars = freq.select(F.explode_outer(F.split("token", "")).alias("token")).where("token <> ''").distinct()
    frequent = freq.where(F.col("freq") >= min_freq).select("token")
    return (
        frequent.unionByName(chars)
        .unionByName(chars.select(F.concat(F.lit("##"), "token").alias("token")))
        .distinct()
    )
