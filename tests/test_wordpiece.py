"""Word pieces by rounds, beside the plain left-to-right rule."""

import random

from pyspark.sql import functions as F

from wordmill.functions import fixed
from wordmill.operators import wordpiece as P


def plain(word, vocab):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocab:
                break
        else:
            return [fixed.UNK]
        out.append(piece)
        at = end
    return out if word and len(word) <= P.MAX_WORD else [fixed.UNK]


def table(spark, tokens):
    return spark.createDataFrame([(t,) for t in tokens], "token string")


def test_pieces_equal_the_plain_rule(spark):
    rng = random.Random(11)
    letters = "abcé"
    some = lambda lo, hi: "".join(rng.choices(letters, k=rng.randint(lo, hi)))
    words = sorted({some(1, 9) for _ in range(200)} | {some(20, 100) for _ in range(20)} | {"a" * 100, "a" * 101, "##ab", "##", "x", "ax"})
    narrow = {"a", "b", "##a", "##b", "##c", "##é", "##"}
    wide = {some(1, 6) for _ in range(40)} | {"##" + some(1, 40) for _ in range(60)} | set(letters) | {"##" + c for c in letters}
    for vocab in (narrow, wide, {"a", "abc"}, {"##a"}):
        got = P.wordpieces(table(spark, words + words[:5]), table(spark, sorted(vocab))).collect()
        assert {r["token"]: r["pieces"] for r in got} == {w: plain(w, vocab) for w in words}
        assert len(got) == len(words) and all(r["n_pieces"] == len(r["pieces"]) for r in got)
    got = P.wordpieces(table(spark, ["a"]), table(spark, ["a"]).limit(0)).collect()
    assert [(r["token"], r["pieces"]) for r in got] == [("a", [fixed.UNK])]


def test_words_ask_for_few_pieces(spark):
    """A word of 100 letters asks a vocabulary of 20 lengths for 20 pieces a start and 60 a round, not for 5,050."""
    front = table(spark, ["a" * 100]).select("token", F.lit(2).alias("at"))
    lengths = list(range(20, 0, -1))
    assert P.piece_candidates(front, [1], lengths, 1).count() == 20
    assert P.piece_candidates(front, [1], lengths, P.PER_ROUND // 20).count() == 60
    # only lengths that the vocabulary has, and heads at the first start alone
    assert P.piece_candidates(front.withColumn("at", F.lit(97)), [1], [40, 4, 1], 2).count() == 3
    assert P.piece_candidates(front.withColumn("at", F.lit(1)), [7, 5], [4], 3).count() == 4
