import hashlib
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordmill.functions.hashing import hash_key
from wordmill.operators import swap as W
from wordmill.operators import vocab as V
from wordmill.operators import wordpiece as P
from wordmill.operators.scale import settle


def edits(a, b):
    row = range(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def far(a, b):
    return edits(a, b) / max(len(a), len(b)) > 0.3


def words(spark, n=400, seed=1, letters="abc"):
    """Short words over few letters, so that many pairs are too similar."""
    rng = random.Random(seed)
    found = {"".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n)}
    rows = [(w, rng.randint(1, 30), rng.choice([1, 1, 1, 2, 3])) for w in sorted(found)]
    return settle(spark.createDataFrame(rows, "token string, freq bigint, n_pieces int"))


def ranked_groups(vocab):
    rows = vocab.withColumn("h", F.md5("token")).collect()
    groups = {}
    for r in sorted(rows, key=lambda r: (-r.freq, r.h)):
        groups.setdefault(r.n_pieces, []).append(r)
    return groups


def as_map(df):
    rows = df.collect()
    mapping = {r.src: r.dst for r in rows}
    assert len(mapping) == len(rows)
    return mapping


@pytest.mark.parametrize("block", [2, 7, 64, 4096])
@pytest.mark.parametrize("lemma", [False, True])
def test_greedy_equals_the_sequential_rule(spark, block, lemma):
    vocab = words(spark)
    if lemma:
        vocab = vocab.withColumn("forms", F.array(F.substring("token", 1, 2)))
    want = {}
    for rows in ranked_groups(vocab).values():
        taken = set()
        for i, a in enumerate(rows):
            want[a.token] = a.token
            for j, b in enumerate(rows):
                related = lemma and set(a.forms) & set(b.forms)
                if i != j and b.token not in taken and not related and far(a.token, b.token):
                    taken.add(b.token)
                    want[a.token] = b.token
                    break
    got = as_map(W.swap_greedy(vocab, forms="forms" if lemma else None, block=block))
    assert got == want


def test_rank_swap_is_a_valid_involution(spark):
    vocab = words(spark)
    mapping = as_map(W.swap_rank(vocab))
    size = {r.token: r.n_pieces for r in vocab.collect()}
    assert set(mapping) == set(size)
    for a, b in mapping.items():
        assert mapping[b] == a and size[a] == size[b]
        assert a == b or far(a, b)


def test_lemma_swap_equals_the_sequential_repair(spark):
    vocab = words(spark, letters="ab").withColumn("forms", F.array(F.substring("token", 1, 2)))
    vocab = settle(vocab)
    forms = {r.token: set(r.forms) for r in vocab.collect()}
    buckets = {}
    for r in V.coarse_buckets(vocab).withColumn("h", hash_key(5, "token")).collect():
        buckets.setdefault((r.n_pieces, r.bucket), []).append(r)
    ok = lambda a, b: not forms[a] & forms[b] and far(a, b)
    want = {}
    for rows in buckets.values():
        order = [r.token for r in sorted(rows, key=lambda r: r.h)]
        k = len(order) // 2
        match = {w: order[(i - k) % len(order)] for i, w in enumerate(order)}
        clash = [(a, b) for a, b in match.items() if not ok(a, b)]
        for a, b in clash:
            for w in order:
                if ok(a, w):
                    match[w], match[a] = b, match[w]
                    break
        want |= match
    assert as_map(W.swap_lemma(vocab, "forms", 5)) == want


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_trades_equal_the_sequential_ones(spark, hot):
    """Chains of trades through partners that trade themselves; with ``hot`` most words of a bucket trade with its first one."""
    rng = random.Random(3)
    turned, trades, want = [], [], {}
    for g, n in (("a", 400), ("b", 40), ("c", 1)):
        names = [f"{g}{i}" for i in range(n)]
        cell = dict(zip(names, rng.sample(names, n)))
        turned += [(g, i, w, cell[w]) for i, w in enumerate(names)]
        first = dict(cell)
        for i, w in enumerate(names):
            partner = names[0] if rng.random() < hot else rng.choice(names)
            if n > 1 and rng.random() < 0.7 and partner != w:
                trades.append((g, i, w, first[w], partner))
                cell[partner], cell[w] = first[w], cell[partner]
                want |= {w: None, partner: None}
        want |= {w: cell[w] for w in names if w in want}
    got = W._traded(
        settle(spark.createDataFrame(turned, "group string, at bigint, token string, dst string")),
        settle(spark.createDataFrame(trades, "group string, at bigint, token string, dst string, with_token string")),
    )
    assert as_map(got) == want and got.count() == len(want)


@pytest.mark.parametrize("make", [lambda v: W.swap_rotate(v, 3), lambda v: W.swap_mutual(v, 3), lambda v: W.swap_random(v, 3)])
def test_permutations(spark, make):
    vocab = words(spark)
    mapping = as_map(make(vocab))
    assert set(mapping) == set(mapping.values()) == {r.token for r in vocab.collect()}


def test_rotation_has_no_fixed_point_and_mutual_is_an_involution(spark):
    vocab = words(spark)
    size = {r.token: r.n_pieces for r in vocab.collect()}
    groups = Counter(size.values())
    turned = as_map(W.swap_rotate(vocab, 3))
    assert all(size[a] == size[b] and (a != b or groups[size[a]] == 1) for a, b in turned.items())
    mutual = as_map(W.swap_mutual(vocab, 3))
    assert all(mutual[b] == a for a, b in mutual.items())
    assert sum(a == b for a, b in mutual.items()) == sum(n % 2 for n in groups.values())


def test_near_words_equal_all_pairs(spark):
    vocab = words(spark, 150)
    names = [r.token for r in vocab.collect()]
    for limit in (0.1, 0.3, 1.0):
        got = {(r.a, r.b) for r in W.near_words(vocab, limit).collect()}
        want = {(a, b) for a in names for b in names if edits(a, b) <= 1 and edits(a, b) / max(len(a), len(b)) <= limit}
        assert got == want


def test_short_words_are_near_themselves_only(spark):
    vocab = spark.createDataFrame([(chr(0x4E00 + i),) for i in range(1500)], "token string")
    got = W.near_words(vocab).collect()
    assert len(got) == 1500 and all(r.a == r.b for r in got)


def test_weights_join_the_map(spark):
    vocab = spark.createDataFrame([("a", 3), ("b", 2)], "token string, freq bigint")
    mapping = spark.createDataFrame([("a", "b"), ("b", "a"), ("new", "x")], "src string, dst string")
    assert {tuple(r) for r in W.weighed(mapping, vocab).collect()} == {("a", "b", 3), ("b", "a", 2), ("new", "x", 0)}


def test_vocabulary_permutation_stays_in_category(spark):
    rows = [(f"[unused{i}]", i) for i in range(999)] + [(f"w{i}", i) for i in range(999, 2300)]
    rows[5] = ("[CLS]", 5)
    vocab = spark.createDataFrame(rows, "token string, id bigint")
    got = W.permute_vocab(vocab, 9).collect()
    ids = dict(rows)
    edges = [998, 1013, 1023, 1036, 1062, 1995]
    kind = lambda t: next((e for e in edges if ids[t] <= e), len(t.encode()))
    assert len(got) == len(rows) and {r.new_token for r in got} == set(ids)
    assert all(kind(r.token) == kind(r.new_token) for r in got)
    assert [r.new_token for r in got if r.token == "[CLS]"] == ["[CLS]"]


def test_out_of_vocabulary_needs_enough_words(spark):
    task = spark.createDataFrame([("a", 2), ("b", 1)], "token string, freq bigint")
    external = spark.createDataFrame([("a", 5), ("c", 1)], "token string, freq bigint")
    with pytest.raises(ValueError):
        W.swap_oov(task, external, 1, "similar")


def greedy_pieces(word, vocab):
    if len(word) > 100:
        return ["[UNK]"]
    out, start = [], 0
    while start < len(word):
        for end in range(len(word), start, -1):
            piece = ("##" if start else "") + word[start:end]
            if piece in vocab:
                out.append(piece)
                start = end
                break
        else:
            return ["[UNK]"]
    return out


def test_wordpieces_equal_greedy_matching(spark):
    rng = random.Random(2)
    pieces = {"".join(rng.choices("abcd", k=rng.randint(1, 4))) for _ in range(60)}
    vocab = {rng.choice(["", "##"]) + p for p in pieces} | {"a", "##a", "##b"}
    names = {"".join(rng.choices("abcde", k=rng.randint(1, 12))) for _ in range(500)} | {"a" * 100, "a" * 101}
    found = P.wordpieces(
        settle(spark.createDataFrame([(n,) for n in names], "token string")),
        settle(spark.createDataFrame([(v,) for v in vocab], "token string")),
    ).collect()
    assert {r.token: r.pieces for r in found} == {n: greedy_pieces(n, vocab) for n in names}


def test_nonsense_words_grow_longer_when_they_are_too_few(spark):
    """More words than strings of two letters: strings of three and four follow, by length and alphabet."""
    pieces = ["a", "b", "c", "##a", "##b", "##c", "ab", "##ca"]
    vocab = settle(spark.createDataFrame([(f"w{i}",) for i in range(60)], "token string"))
    got = W.swap_nonsense(vocab, settle(spark.createDataFrame([(p,) for p in pieces], "token string")), 4, letters=2).collect()
    fit = ["".join(s) for n in (2, 3, 4) for s in itertools.product("abc", repeat=n)]
    fit = [s for s in fit if greedy_pieces(s, set(pieces)) == [s[0], *["##" + x for x in s[1:]]]]
    order = sorted((f"w{i}" for i in range(60)), key=lambda w: hashlib.md5(f"4|{w}".encode()).hexdigest())
    assert len(fit) > 60 > sum(len(s) < 4 for s in fit) and {r.src: r.dst for r in got} == dict(zip(order, fit)) and len(got) == 60


def test_nonsense_words_run_out(spark):
    vocab = settle(spark.createDataFrame([("x",), ("y",), ("z",)], "token string"))
    with pytest.raises(ValueError):
        W.swap_nonsense(vocab, settle(spark.createDataFrame([("a",), ("b",)], "token string")), 4, letters=2)
