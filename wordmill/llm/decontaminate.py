"""Benchmark items in texts: SimHash fingerprints of item-sized windows, a multi-index over them, exact verification.

Words are stretches of letters and digits of the text in small letters (places are bytes of that); a shingle is five of them (the whole item if it is shorter). For
every item, windows of as many words as the item has are fingerprinted with 256 weighted bits. For each of the 32 bytes a table
holds, as a row of bits, the items whose byte is within two bits of each value: two fingerprints with fewer than ``LEAST`` such bytes differ in
three bits at least in each of the others, so in more than ``RADIUS``. The rows of bits of a window's bytes are added up digit by digit, and the items with
``LEAST`` bytes or more, among which are all within ``RADIUS`` and about one in a thousand of the unrelated ones, go on; the exact distance is then
checked. What remains is verified by weighted Jaccard similarity of the distinct shingles. A shingle of n items weighs
1 / n, one of no item weighs 1, but none weighs more than the item's ``cap``: the mean of the item's own weights, rounded down to a
power of two. So a changed word weighs no more than the item's words do, however many items share these.
Holders are counted once over all different item texts; texts that are equal in small letters are one item with several ids.

A row with fewer words than an item is one window for it, and its similarity with every such item that it shares a shingle with
comes from the postings of the shingles, without fingerprints.

Windows that hold no shingle of an item of their size have similarity 0 with all of these and are not fingerprinted.
For two sets of similarity 0.8 a fingerprint bit differs with probability 0.15 at most, 38 of 256 on average; the radius lies four
standard deviations above. Votes are square roots of the weights, so this holds for shingles of unequal weights too, as long as
no few of them outweigh the others.

Different item texts are dealt to passes of about ``ITEMS`` at most, and the result of a pass is written before the next one, so that
one pass is in memory at a time. Shingles of two or more items go to every pass (16 bytes each), so that what is found does not depend
on the passes.

Defined cases: null or empty texts, and items without words, match nothing; equal items match together; of equal similarities
the smaller item id counts, then the earlier window; repeated rows are judged one by one; without items nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.llm.common import arrow, fresh, new_path, settle
from wordmill.llm.hashed import PUNCT, buffers, distinct, grams, mix, runs, words

U = np.uint64
SHINGLE = 5
THRESHOLD = 0.8
#: Bytes of a fingerprint, most bits in which two that belong together differ, bits within which two bytes are near, and how many are then near at least.
WIDTH = 32
RADIUS = 61
NEAR = 2
LEAST = WIDTH - RADIUS // (NEAR + 1)
#: Shingles fingerprinted at a time, so that memory does not follow the length of an item.
STEP = 1 << 16
ITEMS = 20_000
BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def prints(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Fingerprints, ``WIDTH`` bytes each, of rows of shingles with weights; repeats of a shingle weigh 0.

    A vote is the square root of the weight, so bits agree by the cosine whose squares are the weights. That is
    the overlap that is verified: for a weighted Jaccard similarity of s it is at least 2s / (1 + s).
    """
    force = np.sqrt(weights)
    out = np.zeros((len(shingles), WIDTH), np.uint8)
    for part in range(WIDTH // 8):
        salt = U(part * 0xA24BAED4963EE407 % (1 << 64))
        votes = -force.sum(1, keepdims=True) / 2
        for a in range(0, shingles.shape[1], STEP):
            some = shingles[:, a : a + STEP]
            bits = np.unpackbits(mix(some ^ salt).view(np.uint8).reshape(*some.shape, 8), axis=2)
            votes = votes + np.einsum("nmb,nm->nb", bits.astype(np.float32), force[:, a : a + STEP].astype(np.float32))
        out[:, part * 8 : part * 8 + 8] = np.packbits(votes > 1e-4, axis=1)
    return out


def tables(made: np.ndarray) -> np.ndarray:
    """For every byte of a fingerprint and each of its values, the fingerprints near it in that byte, as a row of bits."""
    values = np.arange(256, dtype=np.uint8)[:, None]
    return np.stack([np.packbits(BITS[values ^ made[None, :, block]] <= NEAR, axis=1) for block in range(WIDTH)])


def named(index: np.ndarray, made: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``made``, one of the n fingerprints of the index) with ``LEAST`` near bytes or more.

    Near bytes are counted for all fingerprints of the index at once: ``digits`` holds one row of bits for each binary digit of the count.
    """
    digits: list[np.ndarray] = []
    for block in range(WIDTH):
        carry = index[block][made[:, block]]
        for d, digit in enumerate(digits):
            digits[d], carry = digit ^ carry, digit & carry
        if not block & (block + 1):
            digits.append(carry)
    enough = np.full_like(digits[0], 255)
    for d, digit in enumerate(digits):
        enough = digit & enough if LEAST >> d & 1 else digit | enough
    return np.nonzero(np.unpackbits(enough, axis=1, count=n))


@dataclass
class Sized:
    """Items of one number of words and one cap."""

    words: int
    cap: float
    ids: list[list[int]]
    prints: np.ndarray
    tables: np.ndarray
    shingles: list[np.ndarray]
    anchors: np.ndarray
    #: Items that hold each anchor: those from ``posted[a]`` to ``posted[a + 1]`` of ``holders``; weight of every item.
    posted: np.ndarray
    holders: np.ndarray
    total: np.ndarray


class Items:
    """The items of one pass, ready for lookup in a task."""

    def __init__(self, ids: list[list[int]], texts: list[str], shared: np.ndarray, holders: np.ndarray) -> None:
        """Ids of every different text; ``shared`` are the shingles of two or more of all texts, in order, with their number of texts."""
        self.shared, self.weight = shared, 1 / holders
        data, offsets = buffers(pa.array(texts, pa.string()))
        hashes, rows, _, _ = words(data, offsets, PUNCT)
        size = np.bincount(rows, minlength=len(ids))
        first = np.cumsum(size) - size
        own = [self._shingles(hashes[first[i] : first[i] + size[i]]) for i in range(len(ids))]
        every = [np.unique(x) for x in own]
        self.screen = np.zeros(1 << 20, bool)
        for x in every:
            self.screen[(x >> U(44)).astype(np.int64)] = True
        mean = np.array([self.weights(x, 1.0).mean() if len(x) else 1.0 for x in every])
        caps = 2.0 ** np.floor(np.log2(mean) + 1e-9)
        self.sized = []
        for n, cap in sorted({(int(n), float(cap)) for n, cap in zip(size, caps, strict=True) if n}):
            at = np.flatnonzero((size == n) & (caps == cap))
            step = max(1, STEP // n)
            made = np.concatenate([self.prints(np.stack([own[i] for i in at[a : a + step]]), cap) for a in range(0, len(at), step)])
            sets = [every[i] for i in at]
            joined, of = np.concatenate(sets), np.repeat(np.arange(len(at)), [len(x) for x in sets])
            order = np.argsort(joined, kind="stable")
            anchors, counts = np.unique(joined, return_counts=True)
            posted = np.concatenate([[0], np.cumsum(counts)])
            total = np.bincount(of, self.weights(joined, cap), len(at))
            self.sized.append(Sized(n, cap, [ids[i] for i in at], made, tables(made), sets, anchors, posted, of[order], total))

    @staticmethod
    def _shingles(hashes: np.ndarray) -> np.ndarray:
        k = min(SHINGLE, len(hashes))
        return grams(hashes, np.zeros(len(hashes), np.int64), tuple(range(k)), k)[0] if k else np.zeros(0, U)

    def weights(self, shingles: np.ndarray, cap: float) -> np.ndarray:
        if not len(self.shared):
            return np.full(shingles.shape, cap)
        at = np.minimum(np.searchsorted(self.shared, shingles), len(self.shared) - 1)
        return np.minimum(np.where(self.shared[at] == shingles, self.weight[at], 1.0), cap)

    def prints(self, shingles: np.ndarray, cap: float) -> np.ndarray:
        """Fingerprints of rows of shingles, each shingle of a row counted once."""
        shingles = np.sort(shingles, axis=1)
        weights = self.weights(shingles, cap)
        weights[:, 1:][shingles[:, 1:] == shingles[:, :-1]] = 0
        return prints(shingles, weights / cap)

    def similarity(self, a: np.ndarray, b: np.ndarray, cap: float) -> float:
        """Weighted Jaccard similarity of two sets of distinct shingles."""
        both = np.intersect1d(a, b, assume_unique=True)
        common = self.weights(both, cap).sum()
        return float(common / (self.weights(a, cap).sum() + self.weights(b, cap).sum() - common))

    def whole(self, shingles: np.ndarray, group: Sized) -> np.ndarray:
        """Similarity of a set of distinct shingles with every item of a group."""
        weights = self.weights(shingles, group.cap)
        at = np.minimum(np.searchsorted(group.anchors, shingles), len(group.anchors) - 1)
        held = group.anchors[at] == shingles
        at, own = at[held], weights[held]
        n = group.posted[at + 1] - group.posted[at]
        places = np.repeat(group.posted[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(group.holders[places], np.repeat(own, n), len(group.ids))
        return common / (weights.sum() + group.total - common)

    def find(self, data: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int]]:
        """Row, item, similarity, first and end byte of the best window of each item found in each row."""
        hashes, rows, start, end = words(data, offsets, PUNCT)
        size = np.bincount(rows, minlength=len(offsets) - 1)
        head = np.cumsum(size) - size
        out: list[tuple[int, int, float, int, int]] = []
        at_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for group in self.sized:
            k = min(SHINGLE, group.words)
            if k not in at_size:
                found, _, at = grams(hashes, rows, tuple(range(k)), k)
                whole = np.zeros(len(hashes), U)
                whole[at] = found
                hit = self.screen[(found >> U(44)).astype(np.int64)]
                at_size[k] = whole, at[hit]
            whole, hits = at_size[k]
            if len(hits):
                hits = hits[np.isin(whole[hits], group.anchors)]
            if not len(hits):
                continue
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            short = np.unique(rows[hits])
            for row in short[size[short] < group.words]:
                a, n = int(head[row]), int(size[row])
                same = self.whole(np.unique(whole[a : a + n - k + 1]), group)
                for y in np.flatnonzero(same >= threshold - 1e-9):
                    best[int(row), int(y)] = float(same[y]), a, a + n - 1
            # every window of this many words that holds one of the shingles found
            first = np.unique((hits[:, None] + np.arange(k - group.words, 1)).ravel())
            first = first[(first >= 0) & (first + group.words <= len(hashes))]
            first = first[rows[first] == rows[first + group.words - 1]]
            step = max(1, min(512, STEP // group.words))
            for a in range(0, len(first), step):
                part = first[a : a + step]
                shingles = whole[part[:, None] + np.arange(group.words - k + 1)]
                made = self.prints(shingles, group.cap)
                w, i = named(group.tables, made, len(group.ids))
                close = BITS[made[w] ^ group.prints[i]].sum(1) <= RADIUS
                for x, y in zip(w[close], i[close], strict=True):
                    same = self.similarity(np.unique(shingles[x]), group.shingles[y], group.cap)
                    spot = int(rows[part[x]]), int(y)
                    if same >= threshold - 1e-9 and same > best.get(spot, (0.0,))[0]:
                        best[spot] = same, int(part[x]), int(part[x]) + group.words - 1
            out += [(row, i, same, int(start[p]), int(end[q])) for (row, y), (same, p, q) in best.items() for i in group.ids[y]]
        return out


def mark(docs: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", to: str = "leaks", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with an array of the items found: (similarity, item, first byte, end byte), the best one first."""
    spark = docs.sparkSession
    if to.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the rows have a column {to} already")
    known = items.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("long").alias("id"), F.lower("text").alias("text"))
    known = settle(known.groupBy("text").agg(F.collect_set("id").alias("ids")), "items")
    n = known.count()
    passes = 1 if n <= ITEMS else -(-n * 5 // (4 * ITEMS))
    shared = _shared(known)
    before = None
    found = fresh(docs, *[f"_{to}{p}" for p in range(passes)])
    for p in range(passes):
        rows = known.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == p).collect()
        docs = _mark(docs, [r["ids"] for r in rows], [r["text"] for r in rows], shared, text, found[p], threshold)
        if p + 1 < passes:
            path = new_path(spark, "pass")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            if before:
                at = spark._jvm.org.apache.hadoop.fs.Path(before)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            before = path
    every = F.concat(*[F.col(c) for c in found])
    order = lambda a, b: F.when(a["similarity"] > b["similarity"], -1).when(a["similarity"] < b["similarity"], 1).when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(F.when(a["start"] < b["start"], -1).otherwise(1))
    return docs.withColumn(to, F.array_sort(every, order)).drop(*found)


def _shared(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of two or more item texts, in order, with their number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in runs(batch.column(0)):
                hashes, rows, _, _ = words(data, offsets, PUNCT)
                size = np.bincount(rows, minlength=len(offsets) - 1)
                for k in range(1, SHINGLE + 1):
                    found, of, _ = grams(hashes, rows, tuple(range(k)), k)
                    fit = size[of] == k if k < SHINGLE else size[of] >= k
                    yield pa.RecordBatch.from_arrays([pa.array(distinct(found[fit], of[fit])[0].view(np.int64))], ["shingle"])

    counted = arrow(known.select("text"), run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    shingles = counted["shingle"].to_numpy().view(U)
    order = np.argsort(shingles)
    return shingles[order], counted["n"].to_numpy()[order]


def _mark(docs: DataFrame, ids: list[list[int]], texts: list[str], shared: tuple[np.ndarray, np.ndarray], text: str, to: str, threshold: float) -> DataFrame:
    names, width = [*docs.columns, to], len(docs.columns)
    kind = T.StructType([T.StructField("similarity", T.DoubleType()), T.StructField("item", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    shape = pa.list_(pa.struct([("similarity", pa.float64()), ("item", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts, *shared)
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for a, _, data, offsets in runs(batch.column(width)):
                for row, item, same, start, end in items.find(data, offsets, threshold):
                    found[a + row].append({"similarity": same, "item": item, "start": start - int(offsets[row]), "end": end - int(offsets[row])})
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(found, shape)], names)

    small = docs.select(*docs.columns, F.lower(text).alias(*fresh(docs, f"{to}_text")))
    return arrow(small, run, T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(kind))]))
