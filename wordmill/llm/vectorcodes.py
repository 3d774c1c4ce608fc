"""Short codes for vectors: one codebook for each part of a vector, learned by rounds of exact integer assignment.

A vector's components become integers and the vector is cut into consecutive parts. The codebook of a part starts with that
part of the vectors with the smallest keys; every round assigns each part to its nearest entry and replaces an entry by
the rounded mean of its parts.

For each part position, all rows are sorted along a Hilbert curve and cut into flat blocks of neighbours, once. A block stores
the box of its rows (smallest and largest component) and their sum. In every round the distances from the box to all entries
give the block a shortlist: an entry stays if its nearest possible distance does not exceed the smallest of the farthest possible ones.
If one entry is left, the whole block is assigned by its stored sum; else a small integer kernel compares the rows with
the shortlist alone. The curve decides only how tight the boxes are, never the result.

Only codebooks (parts x entries x components) and their sums go through the driver, in every round the same number for a length of vectors.
All integers are exact: products run in double precision where every sum stays below 2**53, else in 64-bit integers.

Defined cases: vectors that are null or hold null or non-finite components are dropped; components beyond +-16384 count as
+-16384; vectors of each length have codebooks of their own; a length that the number of parts does not divide makes the
later parts longer by one; empty vectors have error 0 and code 0. Fewer rows than entries give fewer entries. Seeds are ordered by key, nulls last, then by
vector, so ties are settled and repeated rows seed as often as they occur; equal distances go to the lower entry; entries without rows stay. Rows
with a null key are coded as any other; null labels are one label. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.llm.common import arrow, settle, spread_join
from wordmill.operators.scale import BROADCAST_BYTES, table_bytes, task_count

PARTS, ENTRIES, ROUNDS = 4, 256, 4
FACTOR, LARGEST = 1024, 1 << 24
#: Rows of a block, and bits of a place on the curve.
BLOCK, CURVE_BITS = 64, 128

#: Codebooks by (length, part): entries x components.
Books = dict[tuple[int, int], np.ndarray]


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integers(vector: Column, factor: int = FACTOR) -> Column:
    limit = float(LARGEST)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), x.cast("double") * factor))))


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def along_curve(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of every row of cells (each below 2**bits), as bytes that sort in the curve's order.

    Works on whole columns: from the highest bit down, the axes are exchanged or inverted so that neighbouring cells stay
    neighbours, then the bits are coded as a Gray code and read across the axes.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            set_ = (x[i] >> bit & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= flip
    across = np.stack([x[i] >> bit & 1 for bit in range(bits - 1, -1, -1) for i in range(n)], 1)
    return np.packbits(across.astype(np.uint8), axis=1)


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact."""
    largest = int(max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * rows.shape[1] * largest * largest < 1 << 53:
        rows, entries = rows.astype(np.float64), entries.astype(np.float64)
    return ((rows * rows).sum(1)[:, None] - 2 * (rows @ entries.T) + (entries * entries).sum(1)).astype(np.int64)


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries that are nearest, or as near as the nearest, for some point of the box; in ascending order."""
    below, above = low - entries, entries - high
    near = (np.maximum(np.maximum(below, above), 0) ** 2).sum(1)
    far = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(1)
    return np.flatnonzero(near <= far.min())


def nearest(rows: np.ndarray, some: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of the shortlist for every row, the lower one of equals, and its squared distance."""
    apart = distances(rows, entries[some])
    at = apart.argmin(1)
    return some[at], apart[np.arange(len(rows)), at]


class Block:
    """Neighbours on the curve of one part position: row numbers, rows, box and sum."""

    def __init__(self, row: dict) -> None:
        self.key, n = (row["dim"], row["part"]), row["n"]
        self.numbers = np.frombuffer(row["numbers"], np.int64)
        self.rows = np.frombuffer(row["rows"], np.int32).reshape(n, -1).astype(np.int64)
        self.low, self.high = np.frombuffer(row["box"], np.int64).reshape(2, -1)
        self.sum = np.frombuffer(row["sum"], np.int64)


def blocks(rows: DataFrame, seeds: dict[int, np.ndarray], parts: int) -> DataFrame:
    """Rows (number, v, dim) as sorted blocks of every part position, settled."""
    spark = rows.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = batch["dim"].to_numpy(), batch["number"].to_numpy()
            for dim in np.unique(lengths):
                here = lengths == dim
                v = batch["v"].filter(pa.array(here)).flatten().to_numpy().astype(np.int64).reshape(int(here.sum()), dim)
                for part, (start, end) in enumerate(bounds(int(dim), parts)):
                    x, n = v[:, start:end], end - start
                    places = np.zeros((len(x), 0), np.uint8)
                    if n:
                        bits = min(8, max(1, CURVE_BITS // n))
                        known = seeds.get(int(dim), v)[:, start:end]
                        least = known.min(0)
                        width = np.maximum(1, known.max(0) - least)
                        places = along_curve(np.clip((x - least) * (1 << bits) // width, 0, (1 << bits) - 1), bits)
                    kinds = [pa.array(np.full(len(x), k, np.int32)) for k in (dim, part)]
                    curve = pa.array([p.tobytes() for p in places], pa.binary())
                    data = pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())
                    yield pa.record_batch([*kinds, curve, pa.array(numbers[here]), data], ["dim", "part", "curve", "number", "x"])

    split = arrow(rows.select("number", "v", "dim"), cut, "dim int, part int, curve binary, number long, x binary")
    order = ["dim", "part", "curve", "number"]
    sorted_ = split.repartitionByRange(task_count(spark), *order).sortWithinPartitions(*order).drop("curve")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key, out = (0, 0), []

        def close() -> None:
            numbers, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            box = np.stack([x.min(0), x.max(0)]).astype(np.int64)
            out.append((*key, len(x), numbers.tobytes(), x.tobytes(), box.tobytes(), x.sum(0, dtype=np.int64).tobytes()))
            held.clear()

        def told() -> pa.RecordBatch:
            kinds = [pa.int32()] * 3 + [pa.binary()] * 4
            batch = pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["dim", "part", "n", "numbers", "rows", "box", "sum"])
            out.clear()
            return batch

        for batch in batches:
            dims, kinds, numbers = batch["dim"].to_numpy(), batch["part"].to_numpy(), batch["number"].to_numpy()
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if start == end:
                    continue
                if held and key != (int(dims[start]), int(kinds[start])):
                    close()
                key = (int(dims[start]), int(kinds[start]))
                x = np.frombuffer(b"".join(batch["x"].slice(start, end - start).to_pylist()), np.int32).reshape(end - start, -1)
                while start < end:
                    some = min(end - start, BLOCK - sum(len(h[0]) for h in held))
                    held.append((numbers[start : start + some], x[:some]))
                    start, x = start + some, x[some:]
                    if sum(len(h[0]) for h in held) == BLOCK:
                        close()
            if len(out) > 1024:
                yield told()
        if held:
            close()
        yield told()

    return settle(arrow(sorted_, pack, "dim int, part int, n int, numbers binary, rows binary, box binary, sum binary"), "blocks")


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row)


def refined(packed: DataFrame, books: Books) -> Books:
    """Codebooks after one round: every entry becomes the rounded-down mean of the parts assigned to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros_like(b) for k, b in books.items()}
        counts = {k: np.zeros(len(b), np.int64) for k, b in books.items()}
        for block in each_block(batches):
            some = shortlist(block.low, block.high, books[block.key])
            if len(some) == 1:
                sums[block.key][some[0]] += block.sum
                counts[block.key][some[0]] += len(block.rows)
            else:
                entry, _ = nearest(block.rows, some, books[block.key])
                np.add.at(sums[block.key], entry, block.rows)
                counts[block.key] += np.bincount(entry, minlength=len(counts[block.key]))
        for (dim, part), n in counts.items():
            used = np.flatnonzero(n)
            if len(used):
                kinds = [pa.array(np.full(len(used), k, np.int32)) for k in (dim, part)]
                rows = pa.array(sums[dim, part][used].tolist(), pa.list_(pa.int64()))
                yield pa.record_batch([*kinds, pa.array(used.astype(np.int32)), pa.array(n[used]), rows], ["dim", "part", "entry", "n", "sum"])

    found = arrow(packed, assign, "dim int, part int, entry int, n long, sum array<long>")
    by = ["dim", "part", "entry"]
    sums = found.select(*by, "n", F.posexplode_outer("sum").alias("at", "x")).groupBy(*by, "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    new = {k: b.copy() for k, b in books.items()}
    for r in sums.where("at IS NOT NULL").collect():
        new[r["dim"], r["part"]][r["entry"], r["at"]] = r["x"] // r["n"]
    return new


def learned(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """Blocks of the rows (number, id, v, dim) and the codebooks after all rounds."""
    first = Window.partitionBy("dim").orderBy(F.asc_nulls_last("id"), "v")
    seeds: dict[int, list] = {}
    top = rows.select("dim", "id", "v").withColumn("at", F.row_number().over(first)).where(F.col("at") <= entries)
    for r in top.orderBy("dim", "at").collect():
        seeds.setdefault(r["dim"], []).append(r["v"])
    starts = {dim: np.array(v, np.int64).reshape(len(v), dim) for dim, v in seeds.items()}
    books = {(dim, p): v[:, a:b].copy() for dim, v in starts.items() for p, (a, b) in enumerate(bounds(dim, parts))}
    packed = blocks(rows, starts, parts)
    for _ in range(rounds):
        books = refined(packed, books)
    return packed, books


def digest(books: Books, dim: int) -> str:
    """Digest of all entries of a length's codebooks, by part, entry and place."""
    numbers = (str(x) for (d, _), b in sorted(books.items()) if d == dim for x in b.ravel().tolist())
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def assigned(packed: DataFrame, books: Books) -> DataFrame:
    """Entry and squared distance of every part of every row: number, part, entry, error."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block in each_block(iter([batch])):
                some = shortlist(block.low, block.high, books[block.key])
                entry, error = nearest(block.rows, some, books[block.key])
                found.append((block.numbers, np.full(len(entry), block.key[1], np.int32), entry.astype(np.int32), error))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found)], ["number", "part", "entry", "error"])

    return arrow(packed, assign, "number long, part int, entry int, error long")


def encode(rows: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Code, error and codebook digest of every usable vector, and the error summed over rows of its label.

    Columns: key, code (entries in hex, by part), error, label_error, codebooks_sha256.
    """
    kept = rows.where(usable(F.col(vector))).select(
        F.col(key).alias("id"), F.col(label).cast("string").alias("label"), integers(F.col(vector)).alias("v"), F.size(vector).alias("dim")
    )
    # numbers are fixed by writing the table: they tell rows with equal keys apart
    kept = settle(kept.withColumn("number", F.monotonically_increasing_id()), "vectors")
    packed, books = learned(kept, parts, entries, rounds)
    shas = F.create_map(*[F.lit(x) for dim in sorted({d for d, _ in books}) for x in (dim, digest(books, dim))]) if books else F.lit(None).cast("map<int,string>")
    digits = max(1, len(f"{entries - 1:x}"))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda x: F.lower(F.lpad(F.hex(x["entry"]), digits, "0"))), "")
    coded = assigned(packed, books).groupBy("number").agg(code.alias("code"), F.sum("error").alias("error"))
    out = settle(kept.select("number", "id", "label", "dim").join(coded, "number").drop("number"), "coded")
    by_label = settle(out.groupBy(F.col("label").alias("its")).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    if table_bytes(by_label) <= BROADCAST_BYTES:
        whole = out.join(F.broadcast(by_label), F.col("label").eqNullSafe(F.col("its")))
    else:
        whole = spread_join(out, by_label.withColumnRenamed("its", "label"), ["label"], "n")
    return whole.select(F.col("id").alias(key), "code", "error", "label_error", shas[F.col("dim")].alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same with all distances, one pair of tables for each round."""
    apart = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - e.v[i]) * (x.v[i] - e.v[i])))::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    near{r} AS MATERIALIZED (
        SELECT number, part, vec_id, label, v, (best // 1000)::BIGINT AS error, (best % 1000)::INT AS entry FROM (
            SELECT x.number, x.part, any_value(x.vec_id) AS vec_id, any_value(x.label) AS label, any_value(x.v) AS v,
                min({apart} * 1000 + e.entry) AS best
            FROM x JOIN book{r} e ON e.part = x.part GROUP BY x.number, x.part))""")
        if r < rounds:
            steps.append(f"""
    mean{r} AS (
        SELECT part, entry, list(m ORDER BY place) AS v FROM (
            SELECT part, entry, place, floor(sum(c)::DOUBLE / count(*))::BIGINT AS m
            FROM (SELECT part, entry, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS place FROM near{r}) GROUP BY part, entry, place)
        GROUP BY part, entry),
    book{r + 1} AS MATERIALIZED (
        SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m ON m.part = b.part AND m.entry = b.entry)""")
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id, embedding) AS number, vec_id, label,
            list_transform(embedding, lambda x: floor({FACTOR} * x::DOUBLE)::BIGINT) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
    x AS MATERIALIZED (
        SELECT number, vec_id, label, p AS part, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v
        FROM kept, range({parts}) t(p)),
    book0 AS MATERIALIZED (SELECT part, (number - 1)::INT AS entry, v FROM x WHERE number <= {entries}),
    {",".join(steps)},
    sha AS (
        SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}),
    told AS (
        SELECT number, any_value(vec_id) AS vec_id, any_value(label) AS label,
            string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error
        FROM near{rounds} GROUP BY number)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM told, sha"""


SQL = _sql()
