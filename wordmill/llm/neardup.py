"""Near-duplicate vectors by cosine, over all pairs: products of int8 tiles, with full precision only where they leave doubt.

Every unit vector u is stored as a scale s and int8 components q, with the length e of what rounding has left: u = s q + r,
|r| = e. Then |u.v - s t q.p| <= |s q| e' + e for any v = t p + r', |r'| = e', so a tile product of the int8 vectors, which is exact,
brackets every cosine of the tile. Pairs whose bracket lies below the threshold are no links, those whose bracket lies above
it are, and only the others are computed anew from the whole vectors in double precision.

Equal vectors are one class with a count, so copies are never paired with each other. Classes are laid out by their nearest
pivot and travel in blocks of a bounded number of rows. Two blocks meet only where the balls around them are near enough for a link
(headers are compared in an equi-join on slots); first only with their int8 rows, and then, if some bracket
reaches the threshold, with whole vectors. What leaves a pair of blocks is a count of links for each class and a
spanning forest of the links, never the pairs, so a group of near copies with a third of all rows stays linear in what it
sends from each pair of blocks. Pivots come from a bounded sample and only decide how rows are laid out.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows without an id;
their component is their own id. Vectors of different lengths link with nothing. Equal vectors always link. Repeated rows
count each; rows that share an id but not the vector are told apart (by a 64-bit hash of the vector). An empty table gives no rows.
Any other columns of the rows are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.llm.common import arrow, settle, spread_join
from wordmill.llm.components import components
from wordmill.operators.scale import BROADCAST_BYTES, task_count

LEAST = 0.95
PIVOTS, SAMPLE = 32, 1024
BLOCK, TILE = 2048, 512
#: Dimensions whose int8 products add up exactly in single precision: 127 * 127 * 1024 < 2**24.
CHUNK = 1024
#: More than the rounding of sums in double precision can amount to.
ROUNDING = 1e-9
BODY = ["n", "ids", "marks", "copies", "bytes", "scales", "errors", "vectors"]


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by the largest component first, so that no square leaves the range."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 components, scales, and a bound of the length of what rounding has left."""
    scales = np.abs(u).max(1) / 127
    q = np.rint(u / scales[:, None])
    return q.astype(np.int8), scales, np.sqrt(((u - q * scales[:, None]) ** 2).sum(1)) + ROUNDING


def spread_out(points: np.ndarray, k: int) -> np.ndarray:
    """At most k of the points, each the farthest from those taken before."""
    taken, far = [0], ((points - points[0]) ** 2).sum(1)
    while len(taken) < k and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[taken[-1]]) ** 2).sum(1))
    return points[taken]


class Rows:
    """One block of classes as a task sees it."""

    def __init__(self, row: dict, prefix: str) -> None:
        get = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        self.n = row[prefix + "n"]
        self.bytes = get("bytes", np.int8).reshape(self.n, -1)
        self.scales, self.errors = get("scales", np.float64), get("errors", np.float64)
        self.wide = self.bytes.astype(np.float32)
        self.lengths = self.scales * np.sqrt((self.wide.astype(np.float64) ** 2).sum(1)) + ROUNDING
        if prefix + "vectors" in row:
            self.ids, self.marks, self.copies = get("ids", np.int64), get("marks", np.int64), get("copies", np.int64)
            self.units = units(get("vectors", np.float32 if len(row[prefix + "vectors"]) == 4 * self.bytes.size else np.float64).reshape(self.n, -1))


def brackets(x: Rows, y: Rows, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of a tile from its int8 product, and how far they may be off."""
    product = np.zeros((len(x.scales[a]), len(y.scales[b])))
    for at in range(0, x.wide.shape[1], CHUNK):
        product += x.wide[a, at : at + CHUNK] @ y.wide[b, at : at + CHUNK].T
    product *= x.scales[a, None]
    product *= y.scales[None, b]
    return product, x.lengths[a, None] * y.errors[None, b] + x.errors[a, None] + ROUNDING


def tiles(x: Rows, y: Rows, same: bool) -> Iterator[tuple[slice, slice]]:
    for i in range(0, x.n, TILE):
        for j in range(i if same else 0, y.n, TILE):
            yield slice(i, min(i + TILE, x.n)), slice(j, min(j + TILE, y.n))


def may_link(x: Rows, y: Rows, same: bool, least: float) -> bool:
    """Whether some pair of the blocks can reach the threshold."""
    for a, b in tiles(x, y, same):
        about, off = brackets(x, y, a, b)
        near = about + off >= least
        if same and a == b:
            near = np.triu(near, 1)
        if near.any():
            return True
    return False


def linked(x: Rows, y: Rows, same: bool, least: float, step: int = 65536) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], list[int]]:
    """Links between two blocks, tile by tile, as places in them; the list counts the pairs computed in full precision."""
    computed = [0]

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in tiles(x, y, same):
            about, off = brackets(x, y, a, b)
            near = about + off >= least
            if same and a == b:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            sure = (about - off)[i, j] >= least + ROUNDING
            i, j = i + a.start, j + b.start
            doubt = np.flatnonzero(~sure)
            computed[0] += len(doubt)
            for at in range(0, len(doubt), step):
                some = doubt[at : at + step]
                sure[some] = np.einsum("ij,ij->i", x.units[i[some]], y.units[j[some]]) >= least
            yield i[sure], j[sure]

    return found(), computed


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the ends of every link; a label is the place of a member."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def blocks(classes: DataFrame, size: int = BLOCK) -> DataFrame:
    """Classes (id, mark, copies, v) in blocks of bounded size, neighbours together: header (ball) and body."""
    spark = classes.sparkSession
    near = classes.select("v").orderBy("mark", "v").limit(SAMPLE).collect()
    by_length: dict[int, list] = {}
    for row in near:
        by_length.setdefault(len(row["v"]), []).append(row["v"])
    pivots = {n: spread_out(units(np.array(v)), PIVOTS) for n, v in by_length.items()}

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["dim"].to_numpy()
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                u = units(matrix(part))
                points = pivots.get(int(dim), u[:1] * 0)
                far = np.stack([((u - p) ** 2).sum(1) for p in points], 1)
                cell = far.argmin(1)
                yield pa.record_batch([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(u)), cell])], [*part.schema.names, "cell", "far"])

    kind = classes.schema["v"].dataType
    plain = classes.select("id", "mark", "copies", "v", F.size("v").alias("dim"))
    laid = arrow(plain, lay, T.StructType([*plain.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())]))
    order = ["dim", "cell", "far", "mark", "id"]
    sorted_ = laid.repartitionByRange(task_count(spark), *order).sortWithinPartitions(*order)
    narrow = isinstance(kind.elementType, T.FloatType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            v = matrix(rows).astype(np.float32 if narrow else np.float64)
            u = units(v)
            q, scales, errors = quantised(u)
            center = u.mean(0)
            radius = float(np.sqrt(((u - center) ** 2).sum(1)).max()) + ROUNDING
            ids, marks, copies = (rows[c].to_numpy().astype(np.int64) for c in ("id", "mark", "copies"))
            body = [pa.array([x.tobytes()], pa.binary()) for x in (ids, marks, copies, q, scales, errors, v)]
            head = [pa.array([u.shape[1]], pa.int32()), pa.array([center.tolist()], pa.list_(pa.float64())), pa.array([radius]), pa.array([len(u)], pa.int32())]
            return pa.record_batch([*head, *body], ["dim", "center", "radius", *BODY])

        count = 0
        for batch in batches:
            dims, cells = batch["dim"].to_numpy(), batch["cell"].to_numpy()
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(cells) != 0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                # a new pivot opens a new block unless that would leave a very small one
                if held and (held[0]["dim"][0].as_py() != dims[start] or (held[-1]["cell"][-1].as_py() != cells[start] and count >= size // 4)):
                    yield told()
                    held, count = [], 0
                while start < end:
                    some = min(end - start, size - count)
                    held.append(batch.slice(start, some))
                    count, start = count + some, start + some
                    if count == size:
                        yield told()
                        held, count = [], 0
        if held:
            yield told()

    body = ", ".join(f"{c} {'int' if c == 'n' else 'binary'}" for c in BODY)
    packed = arrow(sorted_, pack, f"dim int, center array<double>, radius double, {body}")
    return settle(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


def near_blocks(packed: DataFrame, least: float) -> DataFrame:
    """Pairs of blocks (a <= b) whose balls are near enough for a link."""
    slots = task_count(packed.sparkSession)
    head = packed.select("block", "dim", "center", "radius")
    one = head.select(*[F.col(c).alias(f"a_{c}") for c in head.columns], F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot"))
    other = head.select(*[F.col(c).alias(f"b_{c}") for c in head.columns], F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    both = one.join(other, (one["slot"] == other["slot"]) & (F.col("a_dim") == F.col("b_dim")) & (F.col("a_block") <= F.col("b_block")))
    squares = F.zip_with("a_center", "b_center", lambda x, y: (x - y) * (x - y))
    apart = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    reach = F.col("a_radius") + F.col("b_radius") + float(np.sqrt(max(0.0, 2 - 2 * least))) + ROUNDING
    return both.where(apart <= reach).select(F.col("a_block").alias("a"), F.col("b_block").alias("b"))


def met(pairs: DataFrame, packed: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of blocks with the named columns of both."""
    side = lambda s: packed.select(F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def links(classes: DataFrame, least: float = LEAST, size: int = BLOCK) -> DataFrame:
    """For every class that has links, by pair of blocks: id, mark, n (rows linked with it), and a member of its tree (root, root_mark)."""
    packed = blocks(classes, size)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            hits = [r for r in rows if may_link(Rows(r, "a_"), Rows(r, "b_"), r["a"] == r["b"], least)]
            yield pa.record_batch([pa.array([r[s] for r in hits], pa.int64()) for s in "ab"], ["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                same = row["a"] == row["b"]
                x, y = Rows(row, "a_"), Rows(row, "b_")
                shift = 0 if same else x.n
                n, label = np.zeros(shift + y.n, np.int64), np.arange(shift + y.n)
                copies = x.copies if same else np.concatenate([x.copies, y.copies])
                for i, j in linked(x, y, same, least)[0]:
                    j = j + shift
                    np.add.at(n, i, copies[j])
                    np.add.at(n, j, copies[i])
                    label = joined_labels(label, i, j)
                ids = x.ids if same else np.concatenate([x.ids, y.ids])
                marks = x.marks if same else np.concatenate([x.marks, y.marks])
                some = np.flatnonzero(n)
                yield pa.record_batch([pa.array(ids[some]), pa.array(marks[some]), pa.array(n[some]), pa.array(ids[label[some]]), pa.array(marks[label[some]])], ["id", "mark", "n", "root", "root_mark"])

    light = met(near_blocks(packed, least), packed, ["n", "bytes", "scales", "errors"])
    hits = settle(arrow(light, screen, "a long, b long"), "hits")
    return arrow(met(hits, packed, BODY), link, "id long, mark long, n long, root long, root_mark long")


def dedup(rows: DataFrame, key: str, vector: str, least: float = LEAST, size: int = BLOCK) -> DataFrame:
    """One row per row: key, n_links (rows linked directly), component_id (smallest key reachable) and kept (its own)."""
    plain = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    takes = F.col("id").isNotNull() & usable(F.col("v"))
    grouped = plain.where(takes).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = settle(grouped.withColumn("mark", F.xxhash64("v")), "classes")
    found = settle(links(classes, least, size), "links")
    # a class is a pair of its smallest id and its mark; the smallest pair of a component has the smallest id
    tree = found.select(F.struct("id", "mark").alias("a"), F.struct(F.col("root").alias("id"), F.col("root_mark").alias("mark")).alias("b"))
    roots = components(tree.where("a <> b")).select("node.id", "node.mark", F.col("root.id").alias("root"))
    counts = found.groupBy("id", "mark").agg(F.sum("n").alias("n"))
    told = classes.join(counts, ["id", "mark"], "left").join(roots, ["id", "mark"], "left")
    told = told.select("id", "v", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    told = settle(told, "told")
    several = settle(told.where("copies > 1").drop("id"), "several")
    wide = several.agg(F.coalesce(F.sum(8 * F.size("v") + 32), F.lit(0))).first()[0]
    mine = plain.where(takes)
    mine = mine.join(F.broadcast(several), "v") if wide <= BROADCAST_BYTES else spread_join(mine, several, ["v"], "copies")
    out = ["id", "n_links", "component_id"]
    rest = plain.where(~F.coalesce(takes, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = told.where("copies = 1").select(*out).unionByName(mine.select(*out)).unionByName(rest)
    return every.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


SQL = """
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    link AS (
        SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
        WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
    reach AS (
        SELECT vec_id AS a, vec_id AS b FROM embeddings
        UNION
        SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
    component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
    n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
    SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
    FROM embeddings e JOIN component c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
