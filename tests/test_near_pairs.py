"""All pairs of words within a share of the longer length."""

import random

import compare
import pytest

from wordmill.operators import swap as W
from wordmill.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("limit", [0.1, 0.3, 1.0])
def test_near_pairs_equal_all_pairs(spark, limit):
    rng = random.Random(9)
    names = {"abcdefg", "axcdeyg", "abcdefghij", "xbcdyfghiz", "a", "ß", "日本語学"}
    for _ in range(12):
        word = [rng.choice("abé") for _ in range(rng.randrange(1, 15))]
        names.add("".join(word))
        for _ in range(4):
            i, do = rng.randrange(len(word) + 1), rng.randrange(3)
            word[i : i + (do < 2)] = [rng.choice("abé")] if do else []
            names.add("".join(word))
    vocab = spark.createDataFrame([(x,) for x in names], "token string")
    got = [(r.a, r.b) for r in W.near_pairs(vocab, limit).collect()]
    want = {(a, b) for a in names - {""} for b in names - {""} if edits(a, b) / max(len(a), len(b)) <= limit}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("task_pairs", [3, 1 << 22])
def test_heavy_segments_are_split(spark, task_pairs):
    names = {f"{a}{b}thing{c}" for a in "abc" for b in "xyz" for c in ("", "s", "er", "ed")}
    vocab = spark.createDataFrame([(x,) for x in names], "token string")
    got = [(r.a, r.b) for r in W.near_pairs(vocab, 0.3, task_pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in names for b in names if edits(a, b) / max(len(a), len(b)) <= 0.3}


def test_near_pairs_equal_sql(spark):
    got = catalog.QUERIES["near_pairs_benchmark"](spark, FOLDER).toPandas()
    assert compare.difference(got, compare.connect(FOLDER).execute(catalog.SQL["near_pairs_benchmark"]).df()) is None
    assert (got.dist > 0).any()


def test_near_pairs_empty(spark):
    assert W.near_pairs(spark.createDataFrame([], "token string")).collect() == []


@pytest.mark.parametrize("limit", [0.15, 0.3, 0.8])
@pytest.mark.parametrize("cell_words", [2, 1 << 14])
def test_short_words_are_paired_by_forms(spark, limit, cell_words):
    from wordmill.operators import near

    rng = random.Random(4)
    names = {"".join(rng.choice(["sch", "en", "tion", "é", "a😀"]) for _ in range(rng.randrange(1, 6))) for _ in range(90)} | {"aaaaaaa", "aaaaaa", "aabaaaa"}
    lengths = [n for n in sorted({len(x) for x in names}) if near.by_forms(n, limit)]
    vocab = spark.createDataFrame([(x,) for x in names], "token string")
    got = [(r.a, r.b, r.edits, r.n) for r in near.form_pairs(vocab, lengths, limit, cell_words).collect()]
    want = {frozenset((a, b)): edits(a, b) for a in names for b in names if a != b and max(len(a), len(b)) in lengths and edits(a, b) / max(len(a), len(b)) <= limit}
    assert len(got) == len(want) > 0 and {frozenset(r[:2]): r[2] for r in got} == want
    assert all(n == max(len(a), len(b)) for a, b, _, n in got)
