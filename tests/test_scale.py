import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordmill.functions.hashing import hash_key
from wordmill.operators import rewrite, scale, wordpiece
from wordmill.plans import inputs


def skewed(spark, n=5000):
    """A third of the rows share one group."""
    group = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)
    return spark.range(n).select(F.col("id").alias("key"), group.alias("g"), (F.col("id") * 7919 % 101).alias("v"))


def test_numbers_equal_window(spark):
    df = skewed(spark)
    order = [F.desc("v"), F.col("key")]
    got = {r.key: (r.rank, r.n) for r in scale.numbered(scale.numbered(df, order, ["g"]), order, name="n").collect()}
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(*order))).withColumn(
        "n", F.row_number().over(W.orderBy(*order))
    )
    assert got == {r.key: (r.rank, r.n) for r in ranked.collect()}


def test_null_groups_are_numbered(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, key int")
    assert sorted((r.key, r.rank) for r in scale.numbered(df, [F.col("key")], ["g"]).collect()) == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("n", [0, 1, 777, 5000, 9999])
def test_first_rows_are_exact(spark, n):
    df = skewed(spark)
    got = {r.key for r in scale.take_first(df, hash_key(1, "key"), ["key"], n).collect()}
    want = df.withColumn("r", F.row_number().over(W.orderBy(hash_key(1, "key")))).where(F.col("r") <= n)
    assert got == {r.key for r in want.collect()}


def test_first_rows_per_group(spark):
    df = skewed(spark)
    got = scale.take_first(df, hash_key(1, "key"), ["key"], 40, ["g"]).collect()
    order = W.partitionBy("g").orderBy(hash_key(1, "key"))
    want = df.withColumn("r", F.row_number().over(order)).where("r <= 40")
    assert {r.key for r in got} == {r.key for r in want.collect()}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_large_vocabulary_join_equals_broadcast(spark, monkeypatch, how):
    rows = skewed(spark).select("key", F.concat(F.lit("w"), "g").alias("token"))
    table = scale.settle(
        rows.groupBy("token").agg(F.count("*").alias("freq")).where("token <> 'w7'").withColumn("dst", F.upper("token"))
    )
    small = scale.join_by_token(rows, table, how)
    want = sorted(map(str, small.select("key", "token", "dst", "freq").collect()))
    monkeypatch.setattr(scale, "is_small", lambda *_: False)
    large = scale.join_by_token(rows, table, how)
    assert sorted(map(str, large.select("key", "token", "dst", "freq").collect())) == want


def test_swap_with_large_map_equals_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a c", "x"), (2, "", "y"), (3, "c C d!", None), (4, None, "z")], "id int, text string, tag string")
    mapping = scale.settle(spark.createDataFrame([("a", "A1", 2), ("c", "C1", 3)], "src string, dst string, freq int"))
    want = sorted(map(str, rewrite.apply_swap(docs, "id", ["text"], mapping).collect()))
    assert "text='A1 b A1 C1'" in want[0] and "text=''" in want[1] and "text='C1 C1 d !'" in want[2] and "text=None" in want[3]
    monkeypatch.setattr(scale, "is_small", lambda *_: False)
    assert sorted(map(str, rewrite.apply_swap(docs, "id", ["text"], mapping).collect())) == want


def test_swap_with_large_map_reads_the_documents_once(spark, monkeypatch):
    path = scale.new_path(spark, "docs")
    rows = [(i, "the the cat " + ("mat " * (i % 5)) + f"w{i}", i % 3) for i in range(300)]
    spark.createDataFrame(rows, "id int, text string, tag int").write.parquet(path)
    docs = spark.read.parquet(path)
    words = {t for _, text, _ in rows for t in text.split()}
    counts = {w: sum(text.split().count(w) for _, text, _ in rows) for w in words}
    mapping = scale.settle(
        spark.createDataFrame([(w, w.upper(), n) for w, n in counts.items()], "src string, dst string, freq int")
    )
    small = rewrite.apply_swap(docs.drop("tag"), "id", ["text"], mapping)
    want = sorted(map(tuple, small.collect()))
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(scale, "is_small", lambda *_: False)
    large = rewrite.apply_swap(docs.drop("tag"), "id", ["text"], mapping)
    assert sorted(map(tuple, large.collect())) == want
    plan = large._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[0]
    assert sum("FileScan" in line and "text:string" in line for line in initial.splitlines()) == 1


def test_ids_decode_with_a_large_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(scale, "is_small", lambda *_: False)
    vocab = scale.settle(spark.createDataFrame([("a", 1), ("b", 2)], "token string, id int"))
    docs = spark.createDataFrame([(i, [1, 1, 2, 9]) for i in range(500)] + [(900, [])], "key int, ids array<int>")
    got = {r.key: r.tokens for r in wordpiece.decode_ids(docs, "key", "ids", vocab).collect()}
    assert got == {i: ["a", "a", "b", "[UNK]"] for i in range(500)} | {900: []}


def test_common_tokens_are_salted(spark, monkeypatch):
    """A token with half of all rows ends in no task with more than twice a fair share of them."""
    monkeypatch.setattr(scale, "is_small", lambda *_: False)
    monkeypatch.setattr(scale, "task_count", lambda *_: 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token = F.when(F.col("id") % 2 == 0, "the").otherwise(F.concat(F.lit("w"), F.col("id") % 1000))
        rows = spark.range(20000).select("id", token.alias("token"))
        table = scale.settle(rows.groupBy("token").agg(F.count("*").alias("freq")))
        joined = scale.join_by_token(rows, table)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 20000 and max(sizes) <= 2 * 20000 / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_cumulated_sums(spark):
    df = skewed(spark, 500)
    got = {r.key: r.before for r in scale.cumulated(df, [F.col("key")], "v").collect()}
    total, want = 0, {}
    for r in df.orderBy("key").collect():
        want[r.key], total = total, total + r.v
    assert got == want


def test_strict_swap_fails_on_unknown_token(spark):
    docs = spark.createDataFrame([(1, ["a", "b"])], "id int, t array<string>")
    mapping = scale.settle(spark.createDataFrame([("a", "x")], "src string, dst string"))
    with pytest.raises(Exception, match="no replacement"):
        rewrite.apply_swap_tokens(docs, "id", "t", mapping).collect()
    got = rewrite.apply_swap_tokens(docs, "id", "t", mapping, strict=False).first()
    assert got.t == ["x", "b"]


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = Context

    with pytest.raises(ValueError):
        scale.checkpoint_folder(Session)


def test_clean_up_removes_the_run_folder(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scale, "checkpoint_folder", lambda _: str(tmp_path))
    scale.settle(spark.range(3))
    assert [p.name for p in tmp_path.iterdir()] == [f"wordmill-{spark.sparkContext.applicationId}"]
    assert scale.clean_up(spark) and not list(tmp_path.iterdir()) and not scale.clean_up(spark)


def test_local_mode_has_one_temporary_folder(tmp_path):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "local[2]", "applicationId": "test-app"})

    assert scale.checkpoint_folder(Session) == scale.checkpoint_folder(Session)


def test_labelled_documents_start_no_join(spark):
    """Only the two schemas are read while the plan is built."""
    context = spark.sparkContext
    context.setJobGroup("labelled", "plan")
    inputs.labelled(spark, "/root/testdata/sf0.001")
    jobs = context.statusTracker().getJobIdsForGroup("labelled")
    context.setJobGroup("tests", "")
    assert len(jobs) <= 2


def _part_of_the_words_is_common(spark, monkeypatch):
    """A table of 300 words, of which the common ones are broadcast, and the limit that does so."""
    rows = [(i, "the the cat " + ("mat " * (i % 5)) + f"w{i} unseen") for i in range(300)] + [(900, ""), (901, None)]
    counts = {"the": 600, "cat": 300, "mat": 600} | {f"w{i}": 1 for i in range(300)}
    monkeypatch.setattr(scale, "is_small", lambda *_: False)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 1000)
    return spark.createDataFrame(rows, "id int, text string"), counts


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("weighed", [True, False])
def test_only_rare_tokens_are_shuffled(spark, monkeypatch, how, weighed):
    docs, counts = _part_of_the_words_is_common(spark, monkeypatch)
    table = scale.settle(spark.createDataFrame([(w, w.upper(), n) for w, n in counts.items()], "token string, dst string, freq int"))
    table = table if weighed else table.drop("freq")
    tokens = docs.select("id", F.explode_outer(F.split("text", " ")).alias("token"))
    met = []
    real = scale._join_shuffled
    monkeypatch.setattr(scale, "_join_shuffled", lambda rows, *a: met.append(rows) or real(rows, *a))
    got = scale.join_by_token(tokens, table, how)
    want = tokens.join(table, "token", how).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    far = {r.token for r in met[0].collect()}
    assert far == {f"w{i}" for i in range(300)} | {"unseen", ""}


def test_rewriting_and_ids_with_common_and_rare_words(spark, monkeypatch):
    docs, counts = _part_of_the_words_is_common(spark, monkeypatch)
    mapping = scale.settle(spark.createDataFrame([(w, w.upper(), n) for w, n in counts.items()], "src string, dst string, freq int"))
    got = {r.id: r.text for r in rewrite.apply_swap(docs, "id", ["text"], mapping).collect()}
    assert got == {i: " ".join(["THE THE CAT", *["MAT"] * (i % 5), f"W{i} unseen"]) for i in range(300)} | {900: "", 901: None}
    vocab = scale.settle(spark.createDataFrame([(w, i, n) for i, (w, n) in enumerate(counts.items())], "token string, id int, freq int"))
    arrays = docs.select(F.col("id").alias("key"), F.split("text", " ").alias("words"))
    ids = scale.settle(wordpiece.encode_ids(arrays, "key", "words", vocab, -1))
    back = {r.key: r.tokens for r in wordpiece.decode_ids(ids, "key", "ids", vocab).collect()}
    assert back[7] == ["the", "the", "cat", "mat", "mat", "w7", "[UNK]"] and back[900] == ["[UNK]"] and back[901] == [] and len(back) == 302
