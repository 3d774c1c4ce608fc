"""Pairs of words within few edits, found by what is left of both after deletions.

Two words of which the longer has n letters and which are at most k edits apart have a common subsequence of n - k letters, here called a form. The
first letters of a word's forms say in which tasks it meets others; a task works out the forms with these letters and compares words that share one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.operators.scale import is_small, settle, task_count

#: Words up to these many letters are compared by forms if a word has at most so many of them.
LONGEST, FORMS = 64, 2000
#: First letters of a form that name its tasks, rows that one task holds, words with the same first letters that one task compares with each other.
START, TASK_ROWS, CELL_WORDS = 3, 100_000, 16_384
#: Pairs compared at a time.
BATCH = 1 << 15
_FACTOR, _CELL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_STARTS = "key bigint, n int, at int, lead int, word string"


def allowed_edits(longer: int, max_dist: float) -> int:
    return math.floor(max_dist * longer + 1e-9)


def by_forms(longer: int, max_dist: float) -> bool:
    """Whether pairs with this longer length are found by forms; there are too many forms of a long word."""
    k = allowed_edits(longer, max_dist)
    return 0 < k <= longer <= LONGEST and math.comb(longer, k) <= FORMS


def _letters(words: list[str], size: int) -> np.ndarray:
    """Code points of words of the same size, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size)


def _more(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return h * _FACTOR + letter + np.uint64(1)


def _seed(n: int) -> np.uint64:
    return np.uint64(n + 1)


def _leftmost(letters: np.ndarray, kept: tuple[int, ...], start: int) -> np.ndarray:
    """Rows in which the kept places from ``start`` on are the first at which their letters can be had, so that no form comes twice."""
    rows = np.arange(len(letters))
    last = start - 1
    for p in kept:
        for skipped in range(last + 1, p):
            rows = rows[letters[rows, skipped] != letters[rows, p]]
        last = p
    return rows


def _hashed(letters: np.ndarray, kept: tuple[int, ...], h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for p in kept:
            h = _more(h, letters[:, p].astype(np.uint64))
    return h


def _lead(kept: tuple[int, ...], start: int = 0) -> int:
    return next((i for i, p in enumerate(kept) if p != start + i), len(kept))


def _starts(lengths: list[int], max_dist: float):
    """Words with the first letters of their forms: a hash of these, the longer length, the letters used up, and those kept before the first deletion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array(batch.column(0).to_pylist(), dtype=object)
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            for m in np.unique(sizes).tolist():
                mine = words[sizes == m]
                letters = _letters(mine.tolist(), m)
                for n in lengths:
                    k = allowed_edits(n, max_dist)
                    if not m <= n <= m + k:
                        continue
                    q = min(START, n - k)
                    spare = m - (n - k)
                    for kept in combinations(range(q + spare), q):
                        rows = _leftmost(letters, kept, 0)
                        if not len(rows):
                            continue
                        key = _hashed(letters[rows], kept, np.full(len(rows), _seed(n)))
                        at = kept[-1] + 1 if kept else 0
                        number = lambda x: pa.array(np.full(len(rows), x, np.int32))  # noqa: B023, E731
                        columns = [pa.array(key.view(np.int64)), number(n), number(at), number(_lead(kept)), pa.array(mine[rows], pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, ["key", "n", "at", "lead", "word"])

    return run


def _edits(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Edit distances of columns of letters, k + 1 for more than k; ``a`` is not shorter. Only cells within k of the diagonal are filled."""
    n, m = len(a), len(b)
    most = np.uint8(k + 1)
    row = [np.full(a.shape[1], min(j, k + 1), np.uint8) for j in range(m + 1)]
    for i in range(1, n + 1):
        low, high = max(1, i - k), min(m, i + k)
        before = row[low - 1]
        row[low - 1] = np.full(a.shape[1], min(i, k + 1) if low == 1 else most, np.uint8)
        for j in range(low, high + 1):
            cell = before + (a[i - 1] != b[j - 1])
            np.minimum(cell, row[j - 1] + np.uint8(1), out=cell)
            before = row[j]
            if j < i + k:
                np.minimum(cell, before + np.uint8(1), out=cell)
            row[j] = np.minimum(cell, most)
    return row[m]


def _common(a: np.ndarray, b: np.ndarray, codes: np.ndarray, n: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first letters and of all letters of one form of each pair: the start of the longest common subsequence that takes what is equal
    at once and else passes over a letter of ``a`` if that costs nothing."""
    size, other, width = len(a), len(b), a.shape[1]
    best = np.zeros((size + 1, other + 1, width), np.uint8)
    for i in range(size - 1, -1, -1):
        for j in range(other - 1, -1, -1):
            best[i, j] = np.where(a[i] == b[j], best[i + 1, j + 1] + np.uint8(1), np.maximum(best[i + 1, j], best[i, j + 1]))
    best, a, b = best.reshape(-1), a.reshape(-1), b.reshape(-1)
    start, whole = np.empty(width, np.uint64), np.empty(width, np.uint64)
    lane = np.arange(width)
    i, j, taken, h = (np.zeros(width, np.int64) for _ in range(4))
    h = np.full(width, _seed(n))
    q = min(START, t)
    if q == 0:
        start[:] = h
    while len(lane):
        done = taken == t
        if done.any():
            whole[lane[done]] = h[done]
            lane, i, j, taken, h = (x[~done] for x in (lane, i, j, taken, h))
            if not len(lane):
                break
        letter = a[i * width + lane]
        same = letter == b[j * width + lane]
        down = best[((i + 1) * (other + 1) + j) * width + lane] >= best[(i * (other + 1) + j + 1) * width + lane]
        with np.errstate(over="ignore"):
            h = np.where(same, _more(h, codes[letter]), h)
        i = i + (same | down)
        j = j + (same | ~down)
        taken = taken + same
        full = same & (taken == q)
        start[lane[full]] = h[full]
    return start, whole


def _pairs(max_dist: float):
    """Pairs of words that share a form, within the edits allowed, each at one form only: the one that ``_common`` picks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        del parts
        coded = table["word"].combine_chunks().dictionary_encode()
        found = coded.dictionary.to_pylist()
        order = sorted(range(len(found)), key=lambda x: (-len(found[x]), found[x]))
        rank = np.empty(len(found), np.int32)
        rank[order] = np.arange(len(found), dtype=np.int32)
        words = pa.array([found[x] for x in order], pa.string())
        sizes = np.array([len(found[x]) for x in order], np.int32)
        of = rank[coded.indices.to_numpy()]
        codes = np.unique(np.frombuffer("".join(found).encode("utf-32-le"), np.uint32))
        kind = np.uint8 if len(codes) < 256 else np.uint32
        letters = np.full((len(found), int(sizes.max())), len(codes), kind)
        for m in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == m)
            letters[at, :m] = np.searchsorted(codes, _letters([found[order[x]] for x in at], m))
        codes = codes.astype(np.uint64)
        field = lambda c: table[c].to_numpy()
        key, n, at, lead, cell, side = (field(c) for c in ("key", "n", "at", "lead", "cell", "side"))
        key = key.view(np.uint64)
        del table, coded
        for longer in np.unique(n).tolist():
            k = allowed_edits(longer, max_dist)
            t = longer - k
            forms = []
            for m in range(max(1, longer - k), longer + 1):
                for used in np.unique(at[(n == longer) & (sizes[of] == m)]).tolist():
                    rows = np.flatnonzero((n == longer) & (sizes[of] == m) & (at == used))
                    tails = letters[of[rows]]
                    q = min(START, t)
                    for kept in combinations(range(used, m), t - q):
                        good = _leftmost(tails, kept, used)
                        chosen = rows[good]
                        h = key[chosen]
                        with np.errstate(over="ignore"):
                            for p in kept:
                                h = _more(h, codes[tails[good, p]])
                        ahead = np.where(lead[chosen] == used, used + _lead(kept, used), lead[chosen])
                        forms.append((h, chosen, ahead.astype(np.uint8)))
            h, row, ahead = (np.concatenate(x) for x in zip(*forms))
            del forms
            with np.errstate(over="ignore"):
                group = h ^ (cell[row].astype(np.uint64) * _CELL)
            by = np.argsort(group)
            yield from _told(group[by], h[by], of[row[by]], ahead[by], side[row[by]], key[row[by]], words, sizes, letters, codes, longer, k)

    return run


def _told(group, h, word, ahead, side, key, words, sizes, letters, codes, n: int, k: int) -> Iterator[pa.RecordBatch]:
    """Compares the words of each group; of words that stand one, two, ... places apart at a time."""
    first, apart = np.arange(len(group)), 0
    held, count = [], 0
    while True:
        apart += 1
        first = first[: np.searchsorted(first, len(group) - apart)]
        first = first[group[first] == group[first + apart]]
        for low in range(0, len(first), BATCH):
            i = first[low : low + BATCH]
            j = i + apart
            a, b = np.minimum(word[i], word[j]), np.maximum(word[i], word[j])
            good = (sizes[a] == n) & (a != b) & ((side[i] == 0) | (side[i] != side[j])) & (h[i] == h[j])
            # the form that counts begins with all letters at which the two words are equal from the start
            reach = np.minimum(np.minimum(ahead[i], ahead[j]), max(0, n - k - 1))
            good &= (reach >= n - k - 1) | (letters[a, reach] != letters[b, reach])
            held.append((a[good], b[good], i[good]))
            count += int(good.sum())
            if count >= BATCH:
                yield from _checked(held, h, key, words, sizes, letters, codes, n, k)
                held, count = [], 0
        if not len(first):
            break
    if count:
        yield from _checked(held, h, key, words, sizes, letters, codes, n, k)


def _checked(held, h, key, words, sizes, letters, codes, n: int, k: int) -> Iterator[pa.RecordBatch]:
    a, b, i = (np.concatenate(x) for x in zip(*held))
    for m in np.unique(sizes[b]).tolist():
        mine = sizes[b] == m
        x, y, at = a[mine], b[mine], i[mine]
        one, two = letters[x, :n].T.copy(), letters[y, :m].T.copy()
        edits = _edits(one, two, k)
        near = edits <= k
        x, y, at, edits = x[near], y[near], at[near], edits[near]
        if not len(x):
            continue
        start, whole = _common(one[:, near], two[:, near], codes, n, n - k)
        told = (start == key[at]) & (whole == h[at])
        x, y, edits = x[told], y[told], edits[told]
        columns = [words.take(pa.array(x)), words.take(pa.array(y)), pa.array(edits.astype(np.int32)), pa.array(np.full(len(x), n, np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "edits", "n"])


def form_pairs(tokens: DataFrame, lengths: list[int], max_dist: float, cell_words: int = CELL_WORDS) -> DataFrame:
    """``(a, b, edits, n)``: every two different words (column ``token``) within the edits that the longer of them, of n letters, is allowed, once.

    ``lengths`` are those for which ``by_forms`` holds. Rows per word do not grow with the vocabulary; words with the same first letters, if they are
    more than ``cell_words``, are cut into parts, and every two parts are compared in a task of their own.
    """
    least = min((n - allowed_edits(n, max_dist) for n in lengths), default=1)
    size = F.char_length("token")
    words = tokens.select(F.col("token").alias("word")).where((size >= least) & (size <= max(lengths, default=0)))
    starts = words.repartition(task_count(words.sparkSession)).mapInArrow(_starts(lengths, max_dist), _STARTS)
    counts = settle(starts.groupBy("key").agg(F.count("*").alias("rows")), "starts")
    rows = counts.agg(F.sum("rows")).first()[0] or 0
    parts = F.ceil(F.col("rows") / cell_words).cast("int")
    heavy = settle(counts.where(F.col("rows") > cell_words).select("key", parts.alias("parts")), "heavy")
    copies = heavy.agg(F.sum(F.col("parts") * cell_words * F.col("parts"))).first()[0] or 0
    known = F.broadcast(heavy) if is_small(heavy) else heavy
    of = F.coalesce("parts", F.lit(1))
    mine = starts.join(known, "key", "left").withColumns({"parts": of, "c": F.pmod(F.xxhash64("word"), of).cast("int")})
    cells = mine.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("c", "o").cast("bigint"), F.greatest("c", "o")
    cells = cells.select(
        "key", "n", "at", "lead", "word", (low * F.col("parts") + high).alias("cell"), F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2).alias("side")
    )
    tasks = max(task_count(words.sparkSession), (rows + copies) // TASK_ROWS)
    return cells.repartition(tasks, "key", "cell").mapInArrow(_pairs(max_dist), "a string, b string, edits int, n int")
