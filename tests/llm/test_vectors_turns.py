"""Vector codes, vector near-duplicates and conversation repair against plain versions, and their defined cases."""

import hashlib
import heapq
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordmill.llm import neardup, turns, vectorcodes
from wordmill.llm.common import settle, spread_join

NAN, INF = float("nan"), float("inf")


# near-duplicates


def plain_links(rows, least):
    """n_links and component of every row by all pairs; None where the row takes no part."""
    takes = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    near = {i: set() for i in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if takes[a] and takes[b] and len(x) == len(y):
                cos = 1.0 if x == y else np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))
                if cos >= least:
                    near[a].add(b)
                    near[b].add(a)
    out = []
    for a, (key, _) in enumerate(rows):
        if not takes[a]:
            out.append((key, 0, key))
            continue
        seen, todo = {a}, [a]
        while todo:
            k = todo.pop()
            for m in near[k]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out.append((key, len(near[a]), min(rows[m][0] for m in seen)))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neardup_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 12))
    rows = [(int(i), (centers[i % 6] + rng.normal(size=12) * (0.05 + 0.5 * (i % 3 == 0))).astype(np.float32).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # copies: a third of the rows
    rows += [(300 + i, [float(i + 1), 1.0]) for i in range(9)] + [(300, [-5.0, 9.0]), (304, rows[3][1]), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(400, None), (401, []), (402, [0.0] * 12), (403, [1.0, None]), (404, [NAN] * 12), (405, [INF] * 12), (None, rows[7][1]), (406, [-0.0, 3.0]), (407, [0.0, 3.0]), (408, [1e-30, 0.0]), (409, [2e30, 0.0])]
    names = f"vec_id long, embedding array<{kind}>"
    df = spark.createDataFrame(rows, names).withColumns({c: F.lit("x") for c in ("n", "root", "mark", "v", "id", "copies", "component_id")})
    got = neardup.dedup(df, "vec_id", "embedding", 0.95, size=16)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = got.collect()
    assert sorted(((r[0], r[1], r[2]) for r in found), key=str) == plain_links(rows, 0.95)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)


def test_neardup_brackets_hold_and_spare_work():
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(200, 32)), np.repeat(rng.normal(size=(4, 32)), 50, 0) + rng.normal(size=(200, 32)) * 0.2]).astype(np.float32)
    u = neardup.units(v)
    q, scales, errors = neardup.quantised(u)
    x = neardup.Rows({"an": len(v), "abytes": q.tobytes(), "ascales": scales.tobytes(), "aerrors": errors.tobytes(), "avectors": v.tobytes(), "aids": np.arange(400).tobytes(), "amarks": np.arange(400).tobytes(), "acopies": np.ones(400, np.int64).tobytes()}, "a")
    about, off = neardup.brackets(x, x, slice(0, 400), slice(0, 400))
    assert (np.abs(about - u @ u.T) <= off).all() and off.max() < 0.05
    found, computed = neardup.linked(x, x, True, 0.95)
    pairs = {(i, j) for a, b in found for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert pairs == {(i, j) for i, j in np.argwhere(np.triu(u @ u.T, 1) >= 0.95).tolist()}
    assert 0 < len(pairs) and computed[0] < 400 * 399 / 2 / 10


def test_neardup_empty(spark):
    assert neardup.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding").collect() == []


def test_spread_join_salts_hot_keys(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 700).alias("k"))
    told = settle(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    got = spread_join(rows, told, ["k"], "n")
    assert got.columns == ["id", "k", "first"] and got.count() == 3000
    want = {r["k"]: r["first"] for r in told.collect()}
    assert all(want[r["k"]] == r["first"] for r in got.collect())


# vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(key, code, error, label_error, digest) of every usable row, with all distances."""
    kept = [(k, lab, [int(max(-(1 << 24), min(1 << 24, np.floor(float(x) * 1024)))) for x in v]) for k, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for dim in {len(v) for _, _, v in kept}:
        mine = sorted(((k, lab, v) for k, lab, v in kept if len(v) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        codes, errors, numbers = [""] * len(mine), [0] * len(mine), []
        for p in range(parts):
            x = [v[p * dim // parts : (p + 1) * dim // parts] for _, _, v in mine]
            book = [list(r) for r in x[:entries]]
            best = lambda r: min((sum((a - b) ** 2 for a, b in zip(r, e, strict=True)), i) for i, e in enumerate(book))  # noqa: B023, E731
            for _ in range(rounds):
                at = [best(r)[1] for r in x]
                for i in range(len(book)):
                    some = [r for r, j in zip(x, at, strict=True) if j == i]
                    if some:
                        book[i] = [sum(c) // len(some) for c in zip(*some, strict=True)]
            for i, r in enumerate(x):
                error, entry = best(r)
                codes[i] += f"{entry:02x}"
                errors[i] += error
            numbers += [str(c) for e in book for c in e]
        sha = hashlib.sha256(",".join(numbers).encode()).hexdigest()
        out += [(k, c, e, lab, sha) for (k, lab, _), c, e in zip(mine, codes, errors, strict=True)]
    total = {}
    for _, _, e, lab, _ in out:
        total[lab] = total.get(lab, 0) + e
    return sorted([(k, c, e, total[lab], sha) for k, c, e, lab, sha in out], key=str)


def test_codes_equal_plain(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) + 3 * (i % 4) for _ in range(9)], i % 5) for i in range(400)]
    rows += [(1000 + i, rows[11][1], None) for i in range(150)]  # a hot vector
    rows += [(i, [float(rng.randint(-1, 1)) for _ in range(8)], 1) for i in range(40)]  # ties, another length, repeated keys
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2002, [NAN] * 9, 1), (2003, [], 2), (None, [0.5] * 9, 3), (2004, [1e30, -1e30] + [0.0] * 7, 3), (2005, [0.1, 0.2], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("number", "v", "dim", "part", "error", "code", "id")})
    got = vectorcodes.encode(df, "vec_id", "embedding", "label")
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_codes(rows)


def test_shortlists_hold_the_nearest_and_select():
    rng = np.random.default_rng(1)
    left = 0
    for _ in range(200):
        rows = rng.integers(-50, 50, 6) + rng.integers(-6, 7, (20, 6))
        entries = rng.integers(-60, 60, (64, 6))
        some = vectorcodes.shortlist(rows.min(0), rows.max(0), entries)
        entry, apart = vectorcodes.nearest(rows, some, entries)
        every = ((rows[:, None] - entries[None]) ** 2).sum(2)
        assert (entry == every.argmin(1)).all() and (apart == every.min(1)).all()
        left += len(some)
    assert left < 200 * 64 / 2


def test_large_integers_stay_exact():
    rows = np.array([[1 << 24, -(1 << 24)] * 40], np.int64)
    entries = np.array([[-(1 << 24), 1 << 24] * 40, [(1 << 24) - 1, -(1 << 24)] * 40], np.int64)
    assert vectorcodes.distances(rows, entries).tolist() == [[80 * (1 << 50), 40]]


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_steps_to_neighbours(n, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    order = sorted(range(len(cells)), key=lambda i: vectorcodes.along_curve(cells, bits)[i].tobytes()) if n * bits < 8 else None
    places = [p.tobytes() for p in vectorcodes.along_curve(cells, bits)]
    order = sorted(range(len(cells)), key=places.__getitem__)
    assert len(set(places)) == len(cells)
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_codes_empty(spark):
    assert vectorcodes.encode(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label").collect() == []


# conversations


def plain_repair(rows):
    """Faults and cheapest repair of one conversation's rows (turn, role, text), found by searching all edits in order of (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:  # places in ``roles`` decide what is allowed, so a state is (row, last two letters)
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        if (cost, audit) in done or len(audit) > 3 * len(rows) + 3:
            continue
        done.add((cost, audit))

        def put(extra, edit, role, text, step, cost=cost, audit=audit, at=at, roles=roles, lines=lines):
            if role is None:
                heapq.heappush(heap, (cost + extra, audit + edit, at + step, roles, lines))
            elif role and re.fullmatch("s?(ua)*u?", roles + role[0]):
                heapq.heappush(heap, (cost + extra, audit + edit, at + step, roles + role[0], (*lines, f"{role}:{text}")))

        for role in ("user", "assistant"):
            put(3, "I", role, "", 0)
        if at < len(rows):
            _, role, text = rows[at]
            put(4, "D", None, None, 1)
            if faults[at] not in ("blank", "duplicate"):
                cut = 3 if faults[at] else 0
                put(cut, "K", role, text, 1)
                for other in ("user", "assistant"):
                    put(cut + 3, "R", other, text, 1)
    times = [t for t, _, _ in rows if t is not None]
    letters = [r[:1] for _, r, _ in rows]
    return (
        max(times) - min(times) + 1 - len(set(times)) if times else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


@pytest.mark.parametrize("size", [2, 4096])
def test_repair_equals_search(spark, size):
    rng = random.Random(4)
    texts = ["Yes.", "No!", "Cut", " \t", "", "Why? \n", "é", "Yes.", "x" * 5000 + "."]
    rows = [(c, rng.choice([None, *range(7)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "u"]), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", "Null key."), (99, 5, "user", "Same."), *[(99, t, "user", "Same.") for t in range(6, 12)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("conv", "place", "letter", "kind", "audit", "head")})
    plain = turns.turns(df, "conv_id", "turn", "role", "text").withColumn("gone", F.lit(False))
    got = {r["conv"]: tuple(r)[1:] for r in turns.digested(turns.repair(plain, size)).collect()}
    want = {c: plain_repair([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_repaired_rows_stand_in_order(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Why"), (1, 1, "user", "Why"), (2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    plain = turns.turns(spark.createDataFrame(rows, "c long, t long, r string, x string"), "c", "t", "r", "x").withColumn("gone", F.lit(False))
    got = turns.repair(plain).where("place > 0").orderBy("conv", "place").select("conv", "edit", "role", "text").collect()
    assert [tuple(r) for r in got if r["conv"] == 2] == [(2, "K", "user", "Hi."), (2, "K", "assistant", "Ho.")]
    one = [r for r in got if r["conv"] == 1]
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in one))


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "A. b! c?") for c in [*range(60), None] for t in (0, 1, None)]
    plain = turns.turns(spark.createDataFrame(rows, "c long, t long, r string, x string"), "c", "t", "r", "x")
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += [(c, t, "user" if k == 4 else r, "" if k == 1 else "A b c" if k == 2 else x, k == 0)] * (2 if k == 3 else 1)
    got = [tuple(r) for r in turns.damage(plain).select("conv", "turn", "role", "text", "gone").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_nulls_and_empty_tables(spark):
    nulls = spark.createDataFrame([(None, None, None, None)], "c long, t long, r string, x string")
    got = turns.digested(turns.repair(turns.turns(nulls, "c", "t", "r", "x").withColumn("gone", F.lit(False)))).collect()
    assert [tuple(r) for r in got] == [(None, 0, 1, 0, 0, 0, 4, "D", hashlib.sha256(b"").hexdigest())]
    gone = turns.digested(turns.repair(turns.turns(nulls, "c", "t", "r", "x").withColumn("gone", F.lit(True)))).collect()
    assert [tuple(r) for r in gone] == [(None, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert turns.digested(turns.repair(turns.damage(turns.turns(nulls.where("false"), "c", "t", "r", "x")))).collect() == []


def test_shared_endings_are_made_once():
    automaton = turns.Automaton()
    user, answer = turns.LETTERS["u", ""], turns.LETTERS["a", ""]
    endings = sorted((answer + user) * n for n in range(1, 40))
    results = [automaton.repair(e) for e in endings]
    assert [r for r in results] == [(0, "K" * len(e)) for e in endings]
    assert automaton.steps == max(map(len, endings)) and len(automaton.nodes) <= 4
