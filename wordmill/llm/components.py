"""Connected components of an undirected graph given as a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import arrow, settle

#: Links (1 MB of them) that one task follows at once; a graph with more takes distributed rounds until it is done or has no more than these left.
FEW = 1 << 16


def _followed(edges: DataFrame) -> DataFrame:
    """(node, root) from a few links between whole numbers, which fit in one task whatever the size of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
                a, b = root(u), root(v)
                parent[max(a, b)] = min(a, b)
        if parent:
            yield pa.record_batch([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())], ["node", "root"])

    return settle(arrow(edges.coalesce(1), run, "node long, root long"), "roots")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every node that has a link, with the smallest node of its component: (node, root).

    Each round hangs the neighbours of a node below the smallest of them, first the larger ones, then the smaller
    ones, until nothing changes; rounds grow with the logarithm of the longest path. Minima are aggregated before they are shuffled, and
    every round is written, so nothing is recomputed when executors are lost. A round costs seven shuffles however few links there are, so
    ``FEW`` links between whole numbers are followed without rounds.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = settle(edges, "links")
    plain = edges.schema["u"].dataType.simpleString() == "bigint"
    while True:
        if plain and edges.count() <= FEW:
            return _followed(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = settle(small.distinct(), "small")
        # done when every node has one parent and no parent has one itself
        places = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
            edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above"))
        )
        if places.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1").isEmpty():
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
