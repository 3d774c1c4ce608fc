"""Top-k search: groups of vectors compared as matrix products."""

import numpy as np
import pyarrow as pa
import pytest

from wordmill.llm import topk


def group(ids, vectors, points):
    far = np.sqrt(np.stack([((vectors - p).astype(float) ** 2).sum(1) for p in points], 1))
    fields = (np.asarray(ids, np.int64), vectors, (vectors.astype(float) ** 2).sum(1), far)
    row = {"n": len(ids), "width": vectors.itemsize} | dict(zip(("ids", "vectors", "norms", "distances"), (x.tobytes() for x in fields)))
    return topk.Group(pa.Table.from_pylist([row]))


def plain(ids, vectors, asked, k):
    by_id = {i: v for i, v in zip(ids, vectors.astype(object))}
    return {q: sorted((-int(by_id[q] @ w), int(i)) for i, w in zip(ids, vectors.astype(object)) if i != q)[:k] for q in asked}


@pytest.mark.parametrize("scale, kind", [(1, np.float32), (1 << 14, np.float64), (1 << 20, np.int64)])
def test_products_are_exact_and_far_blocks_are_left_out(monkeypatch, scale, kind):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 32)
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (16, 12))
    vectors = (centres[rng.integers(0, 16, 1500)] + rng.integers(-3, 4, (1500, 12))) * scale + rng.integers(0, 2, (1500, 12))
    vectors[::7] = vectors[0]
    ids = np.r_[np.arange(1490), np.full(10, 3000)]
    asked = np.arange(0, 1490, 10)
    q, c = group(asked, vectors[asked], vectors[:16]), group(ids, vectors, vectors[:16])
    assert topk.exact_kind(q, c) is kind
    scores, found, products = topk.nearest(q, c, 5)
    assert {int(x): list(zip((-s).tolist(), f.tolist())) for x, s, f in zip(q.ids, scores, found)} == plain(ids, vectors, asked, 5)
    assert products < 0.8 * len(asked) * len(ids)


def test_fewer_candidates_than_k():
    vectors = np.array([[1, 2], [3, -4], [5, 6]], np.int16)
    q, c = group([0], vectors[:1], vectors[:1]), group([0, 1, 2], vectors, vectors[:1])
    scores, found, _ = topk.nearest(q, c, 5)
    assert found[0][:2].tolist() == [2, 1] and scores[0][:2].tolist() == [17, -5] and (scores[0][2:] == topk._NONE).all()


def test_groups_meet(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 600)
    monkeypatch.setattr(topk, "PACKED", 20)
    rng = np.random.default_rng(4)
    vectors = rng.integers(-40000, 40000, (300, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, v array<long>")
    got = topk.search(df, df.vec_id % 2 == 0, "vec_id", "v", 4).collect()
    want = plain(range(300), vectors, range(0, 300, 2), 4)
    assert sorted((r["query_id"], r["rank"], -r["score"], r["vec_id"]) for r in got) == sorted((q, n + 1, *x) for q, best in want.items() for n, x in enumerate(best))
