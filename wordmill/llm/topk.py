"""Exact top-k search by inner product, with a table of distances to pivots that rules candidates out.

Inner product and distance belong together: 2<q,x> = |q|^2 + |x|^2 - d(q,x)^2. The distances of every vector to a few
pivots are computed once. Candidates that are near the same pivot at a similar distance make up a block, with the least
and the largest distance to each pivot; for a query, what its own distances lack to these is a lower bound of d(q,x) and
so gives an upper bound of <q,x> for all of the block. Blocks are evaluated in the order of that bound, and only for the
queries for which it reaches the k-th best score found, so the answer is exact. Scores are integers; bounds are widened by
more than the rounding of floats. The products of two blocks are one matrix product, in floats if all sums stay exact there.

Queries and candidates are dealt into groups of bounded size; every group of queries meets every group of candidates in an
equi-join on the numbers of both, never in a cross join, and no task holds more than one pair of groups at a time.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without
an id; vectors meet only vectors of their own length; fewer candidates than k give fewer rows; equal scores go to the
smaller id; a query never meets rows of its own id; repeated candidate rows all count; a query id that occurs more
than once is answered once, for its smallest vector in array order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.llm.common import arrow, settle
from wordmill.operators.scale import task_count

PIVOTS = 16
#: Rows of a block that travels, and of the blocks that are compared.
PACKED, QUERIES, CANDIDATES = 512, 256, 1024
#: Components of the vectors of one group.
GROUP = 1 << 21
FIELDS = "dim int, n int, width int, ids binary, vectors binary, norms binary, distances binary"
_NONE = np.iinfo(np.int64).min


def quantised(vector: Column, factor: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def packed(rows: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """Rows (id, v) as blocks: ids, vectors in integers of the bytes they need, squared norms and the table of distances to the pivots."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch["dim"].to_numpy()
            for dim in np.unique(length):
                part = batch.filter(pa.array(length == dim))
                ids = part["id"].to_numpy().astype(np.int64)
                vectors = part["v"].flatten().to_numpy().astype(np.int64).reshape(-1, dim)
                for at in range(0, len(ids), size):
                    v = vectors[at : at + size]
                    norms = (v.astype(float) ** 2).sum(1)
                    points = pivots.get(int(dim), np.zeros((1, dim), np.int64))
                    far = np.sqrt(np.stack([((v - p).astype(float) ** 2).sum(1) for p in points], 1))
                    v = v.astype(np.result_type(np.int16, np.min_scalar_type(v.min()), np.min_scalar_type(-max(0, int(v.max())) - 1)))
                    parts = (ids[at : at + size], v, norms, far)
                    numbers = (pa.array([x], pa.int32()) for x in (dim, len(v), v.itemsize))
                    yield pa.record_batch([*numbers, *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["dim", "n", "width", "ids", "vectors", "norms", "distances"])

    return arrow(rows, pack, FIELDS)


class Group:
    """Vectors of one length, those near the same pivot beside each other."""

    def __init__(self, table: pa.Table) -> None:
        rows = table.select(["n", "width", "ids", "vectors", "norms", "distances"]).to_pylist()
        get = lambda name, kind, r: np.frombuffer(r[name], kind)
        ids, norms = (np.concatenate([get(name, kind, r) for r in rows]) for name, kind in (("ids", np.int64), ("norms", np.float64)))
        vectors = np.concatenate([get("vectors", f"i{r['width']}", r).reshape(r["n"], -1) for r in rows])
        distances = np.concatenate([get("distances", np.float64, r).reshape(r["n"], -1) for r in rows])
        order = np.lexsort((ids, distances.min(1), distances.argmin(1)))
        self.ids, self.norms, self.vectors, self.distances = ids[order], norms[order], vectors[order], distances[order]


def exact_kind(q: Group, c: Group) -> type:
    """Numbers in which no sum of products of these vectors is rounded: no part of a product is larger than the norms' product."""
    most = float(np.sqrt(q.norms.max()) * np.sqrt(c.norms.max())) * 1.01
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def bounds(distances: np.ndarray, norms: np.ndarray, c: Group, size: int) -> np.ndarray:
    """Upper bound of the inner product of every query with every block of ``size`` candidates."""
    starts = np.arange(0, len(c.ids), size)
    low, high = np.minimum.reduceat(c.distances, starts), np.maximum.reduceat(c.distances, starts)
    far = np.zeros((len(norms), len(starts)))
    for p in range(distances.shape[1]):
        own = distances[:, p, None]
        np.maximum(far, np.maximum(low[None, :, p] - own, own - high[None, :, p]), out=far)
    total = norms[:, None] + np.maximum.reduceat(c.norms, starts)[None, :]
    return (total - far * far) / 2 + 1e-9 * total + 1e-3


def improve(known: np.ndarray, ids: np.ndarray, row: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
    """The best of each query (rows of ``known`` scores and ``ids``), with the scores found for some of the rows."""
    k = known.shape[1]
    touched = np.unique(row)
    rows = np.concatenate([np.repeat(touched, k), row])
    scores = np.concatenate([known[touched].ravel(), score])
    names = np.concatenate([ids[touched].ravel(), found])
    # the largest first; the complement turns integers around without overflow
    order = np.lexsort((names, ~scores, rows))
    first = np.searchsorted(rows[order], touched)
    best = order[first[:, None] + np.arange(k)]
    known[touched], ids[touched] = scores[best], names[best]


def nearest(q: Group, c: Group, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the best k candidates of every query, and the number of products computed."""
    kind = exact_kind(q, c)
    none = -np.inf if kind is not np.int64 else _NONE
    known, ids = np.full((len(q.ids), k), _NONE), np.full((len(q.ids), k), np.iinfo(np.int64).max)
    there, products = c.vectors.astype(kind), 0
    by_id = np.argsort(c.ids, kind="stable")
    sorted_ids = c.ids[by_id]
    for at in range(0, len(q.ids), QUERIES):
        mine = slice(at, at + QUERIES)
        here = q.vectors[mine].astype(kind)
        upper = bounds(q.distances[mine], q.norms[mine], c, CANDIDATES)
        first, last = (np.searchsorted(sorted_ids, q.ids[mine], side) for side in ("left", "right"))
        own = np.repeat(np.arange(len(here)), last - first)
        own_at = by_id[np.concatenate([np.arange(x, y) for x, y in zip(first, last)])] if len(own) else own
        for b in np.argsort(-upper.max(0), kind="stable"):
            limit = known[mine, -1]
            may = np.flatnonzero(upper[:, b] >= limit)
            if not len(may):
                continue
            low = b * CANDIDATES
            scores = (here if len(may) == len(here) else here[may]) @ there[low : low + CANDIDATES].T
            products += scores.size
            same = (own_at >= low) & (own_at < low + CANDIDATES) & np.isin(own, may)
            scores[np.searchsorted(may, own[same]), own_at[same] - low] = none
            least = np.where(limit[may] == _NONE, none, limit[may].astype(kind))
            if (limit[may] == _NONE).any() and scores.shape[1] > k:
                least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
            i, j = np.divmod(np.flatnonzero(scores >= least[:, None]), scores.shape[1])
            score = scores[i, j]
            real = score != none
            if real.any():
                i, j, score = i[real], j[real], score[real]
                improve(known[mine], ids[mine], may[i], score.astype(np.int64), c.ids[low + j])
    return known, ids, products


def search(rows: DataFrame, queries: Column, key: str, vector: str, k: int, pivots: int = PIVOTS) -> DataFrame:
    """The k best of all rows for each row where ``queries`` holds: query_id, rank, key, score.

    ``vector`` holds integers (see ``quantised``).
    """
    spark = rows.sparkSession
    plain = rows.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), queries.alias("asks"), F.size(vector).alias("dim")
    )
    # a bounded number of vectors, those with the smallest hash of their id; a length not among them has only the origin
    near = plain.select("dim", "v").orderBy(F.xxhash64(F.col("id")), "v").limit(4 * pivots).collect()
    table = {dim: np.array([r["v"] for r in near if r["dim"] == dim][:pivots], np.int64) for dim in {r["dim"] for r in near}}
    asked = plain.where("asks").groupBy("id", "dim").agg(F.min("v").alias("v"))
    asked = asked.groupBy("id").agg(F.min_by(F.struct("dim", "v"), F.struct("v", "dim")).alias("x")).select("id", "x.dim", "x.v")
    c, q = settle(packed(plain.select("id", "v", "dim"), table, PACKED), "candidates"), settle(packed(asked, table, PACKED), "queries")
    held = lambda x: x.agg(F.sum(F.col("n").cast("long") * F.col("dim"))).first()[0] or 0
    tasks = task_count(spark)
    parts, slots = -(-held(q) // GROUP) or 1, max(2 * tasks, -(-held(c) // GROUP))
    dealt = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["part", "slot", "dim"]
    cells = max(tasks, parts * slots)
    c = c.withColumn("slot", dealt(slots)).withColumn("part", each(parts)).repartition(cells, *cell)
    q = q.withColumn("part", dealt(parts)).withColumn("slot", each(slots)).repartition(cells, *cell)

    def meet(asking: pa.Table, there: pa.Table) -> pa.Table:
        if not asking.num_rows or not there.num_rows:
            return pa.table({x: pa.array([], pa.int64()) for x in ("query_id", "id", "score")})
        here = Group(asking)
        scores, ids, _ = nearest(here, Group(there), k)
        told = scores != _NONE
        return pa.table({"query_id": np.repeat(here.ids, told.sum(1)), "id": ids[told], "score": scores[told]})

    found = q.groupBy(*cell).cogroup(c.groupBy(*cell)).applyInArrow(meet, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


SQL = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
