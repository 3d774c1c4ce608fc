import unicodedata

import pytest
from pyspark.sql import functions as F

from wordmill.functions import fixed
from wordmill.functions import text as T

EDGES = [
    "a\x00b�c d　e", "日本語 テスト중국어 한국 가각힣", "Café naïve ÉÀ ǅ İstanbul ΣΑΣ", "x y z\x85w\x1cq",
    "don't [SEP] a-b_c $5+3=8 ≠ ﬁ", "क़ো ᄀ", "", "  \t\n", "🙂👍 ok​zero", "中́x", "; `", "tab\there\r\nline",
]


def plain_tokens(text):
    """One character at a time, straight from the rules."""
    out = []
    for ch in text:
        cat = unicodedata.category(ch)
        if ch in "\t\n\r" or cat == "Zs":
            out.append(" ")
        elif ord(ch) in (0, 0xFFFD) or cat.startswith("C"):
            continue
        elif any(lo <= ord(ch) <= hi for lo, hi in fixed.CJK_RANGES):
            out += [" ", ch, " "]
        else:
            out.append(ch)
    words = []
    for word in "".join(out).split():
        folded = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")
        spaced = "".join(
            f" {c} " if unicodedata.category(c).startswith("P") or (c.isascii() and not c.isalnum() and c.isprintable()) else c
            for c in folded
        )
        words += spaced.split()
    return words


def test_tokens_match_plain_tokenizer(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(t,) for t in EDGES + docs], "text string")
    for row in df.select("text", T.basic_tokens("text").alias("t")).collect():
        assert row.t == plain_tokens(row.text)


def test_never_split_words_pass_through(spark):
    df = spark.createDataFrame([("Don't [SEP] [sep] X[SEP]",)], "text string")
    got = df.select(T.basic_tokens("text", never_split=["[SEP]"]).alias("t")).first().t
    assert got == ["don", "'", "t", "[SEP]", "[", "sep", "]", "x", "[", "sep", "]"]


def test_case_and_accent_options(spark):
    df = spark.createDataFrame([("Été",)], "text string")
    row = df.select(
        T.fold("text", lower=True, strip=False).alias("a"),
        T.fold("text", lower=False).alias("b"),
        T.fold("text", lower=False, strip=True).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == ("été", "Été", "Ete")


def test_presence(spark):
    df = spark.createDataFrame([(None,), ("",), (" 　",), (" None ",), ("none",)], "text string")
    assert [r[0] for r in df.select(T.is_present("text")).collect()] == [False, False, False, False, True]


def test_edit_distance_of_empty_words(spark):
    df = spark.createDataFrame([("", ""), ("", "ab"), ("abc", "abd")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(T.norm_lev("a", "b")).collect()] == [0.0, 1.0, 0.333333]


@pytest.mark.parametrize("p", [0.0, 0.3, 1.0])
def test_scrambled_window_keeps_tokens(spark, p):
    df = spark.range(50).select("id", F.transform(F.sequence(F.lit(1), (F.col("id") + 1).cast("int")), lambda x: x.cast("string")).alias("t"))
    for row in df.select("t", T.scramble_window("t", F.col("id").cast("string"), p, 1).alias("s")).collect():
        assert sorted(row.t) == sorted(row.s)
        moved = [i for i, (a, b) in enumerate(zip(row.t, row.s)) if a != b]
        assert not moved or moved[-1] - moved[0] < int(len(row.t) * p)


def test_join_pieces(spark):
    df = spark.createDataFrame([(["un", "##aff", "##able", "word"],)], "t array<string>")
    assert df.select(T.join_pieces("t")).first()[0] == "unaffable word"
