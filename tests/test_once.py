"""Texts are tokenised once for the rewrite and for the features, and first appearances are found without sorting."""

import pytest
from pyspark.sql import functions as F

from wordmill.functions.text import is_present
from wordmill.operators import features, rewrite, scale, vocab


def _docs(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, " ".join(f"w{i % 7} v{(i * j) % 90}" for j in range(12))) for i in range(60)] + [(60, None), (61, " "), (62, "None")]
    df = spark.createDataFrame(rows, "k bigint, text string")
    plain = df.localCheckpoint()
    return plain, plain.mapInArrow(count, plain.schema), seen


def _large(monkeypatch):
    monkeypatch.setattr(scale, "is_small", lambda *_: False)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 1000)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_a_large_table_makes_the_rows_once(spark, monkeypatch, how):
    plain, counted, seen = _docs(spark)
    index = scale.settle(vocab.vocab_index(plain.where("k > 3").withColumn("s", F.lit(0)), "s", "k", ["text"]), "index")
    index = scale.settle(index.where("idx % 5 > 0"), "index")
    tokens = lambda df: df.select("k", F.explode_outer(F.split("text", " ")).alias("token"))
    want = sorted(map(tuple, scale.join_by_token(tokens(plain), index, how).select("k", "idx").collect()), key=str)
    _large(monkeypatch)
    got = scale.join_by_token(tokens(counted), index, how, once=True).select("k", "idx").collect()
    assert sorted(map(tuple, got), key=str) == want and seen.value == 63


def test_features_with_a_large_index(spark, monkeypatch):
    plain, _, _ = _docs(spark)
    index = scale.settle(vocab.vocab_index(plain.withColumn("s", F.lit(0)), "s", "k", ["text"]), "index")
    want = sorted(map(tuple, features.bow(plain, "k", ["text"], index).collect()))
    _large(monkeypatch)
    assert sorted(map(tuple, features.bow(plain, "k", ["text"], index).collect())) == want


def test_rewrite_with_a_large_map_makes_the_rows_once(spark, monkeypatch):
    plain, counted, seen = _docs(spark)
    freq = scale.settle(vocab.doc_freq(plain, ["text"]), "freq")
    mapping = scale.settle(freq.select(F.col("token").alias("src"), F.reverse("token").alias("dst"), "freq"), "map")
    want = sorted(map(tuple, rewrite.apply_swap(plain, "k", ["text"], mapping).collect()), key=str)
    _large(monkeypatch)
    got = rewrite.apply_swap(counted, "k", ["text"], mapping).collect()
    assert sorted(map(tuple, got), key=str) == want and seen.value == 63


@pytest.mark.parametrize("step", [1, 1 << 40])
def test_first_appearance_of_near_and_far_keys(spark, step):
    rows = [(s, None if r == 3 else (r - 2) * step, f"x{r} a{r % 2} x{s} a{s}") for s in (1, 0) for r in range(4)]
    df = spark.createDataFrame(rows, "s int, k bigint, text string")
    assert (vocab._row_place(df, "s", "k") is None) == (step > 1)
    order = []
    for _, _, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        order += [t for t in text.split() if t not in order]
    assert {r["token"]: r["idx"] for r in vocab.vocab_index(df, "s", "k", ["text"]).collect()} == {t: i for i, t in enumerate(order)}


def test_presence_equals_the_stripped_text(spark):
    parts = ["", " ", "\n", "　", "\x85", "None", "None\x85", "a", " "]
    df = spark.createDataFrame([(a + b + c,) for a in parts for b in parts for c in parts] + [(None,)], "text string")
    stripped = F.regexp_replace("text", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    old = F.coalesce(~stripped.isin("", "None"), F.lit(False))
    assert df.where(is_present("text") != old).collect() == []


def test_blocks_of_rows_are_packed_with_their_features_numbered():
    import pyarrow as pa

    from wordmill.operators import models

    kind = pa.list_(pa.struct([("idx", pa.int64()), ("x", pa.float64())]))
    for scale_by, width in ((1.0, 1), (0.5, 8)):
        cells = [[(-1, 1.0), (10**12, 255.0)], [(-1, 1.0)], [], [(7, 3.0), (-1, 1.0), (7, 1.0)]]
        f = pa.array([[{"idx": i, "x": x * scale_by} for i, x in row] for row in cells], kind)
        rows = pa.table({"block": pa.array([5] * 4, pa.int32()), "label": pa.array([0, 1, 2, 1], pa.int32()), "f": f})
        packed = models._packed_block(rows)
        assert packed["width"].to_pylist() == [width] and packed["block"].to_pylist() == [5]
        [rates] = [b.to_pydict() for b in models._block_rates(packed.to_batches())]
        assert rates == {"idx": [-1, 7, 10**12], "block": [5] * 3, "n": [3, 2, 1], "pull": [x * scale_by**2 for x in (256.0 + 1 + 5, 20.0, 255 * 256.0)]}
        point = pa.table({"idx": [7, 10**12, -1], "v0": [0.0, 0.0, 0.0], "v1": [0.0, 0.0, 0.0], "v2": [0.0, 0.0, 0.0]})
        slopes = models._block_slopes(3)(packed, point).to_pydict()
        assert slopes["idx"] == [-1, 7, 10**12] and slopes["g1"] == pytest.approx([-1.0 * scale_by, -8 / 3 * scale_by, 255 / 3 * scale_by])
        empty = models._packed_block(pa.table({"block": pa.array([1], pa.int32()), "label": pa.array([0], pa.int32()), "f": pa.array([[]], kind)}))
        assert [b.num_rows for b in models._block_rates(empty.to_batches())] == [0]
