import pytest
from pyspark.sql import functions as F

from wordmill.functions import fixed
from wordmill.operators import runs
from wordmill.sources import readers, writers


def test_tree_phrases(spark):
    lines = [(1, "(3 (2 The) (4 (3 good) (2 film)))"), (2, "(2 word)"), (3, "(9 (0 bad) (x odd))")]
    df = spark.createDataFrame(lines, "id int, line string")
    got = sorted((r.id, r.node_id, r.text, r.label) for r in readers.tree_spans(df, "id", "line").collect())
    assert got == [
        (1, 0, "The good film", 1), (1, 1, "The", 2), (1, 4, "good film", 1), (1, 5, "good", 1), (1, 8, "film", 2),
        (2, 0, "word", 2), (3, 0, "bad odd", None), (3, 1, "bad", 0), (3, 4, "odd", None),
    ]
    roots = readers.tree_spans(df, "id", "line", include_subtrees=False, classes=fixed.NEUTRAL_TREE_LABELS)
    assert sorted((r.id, r.text, r.label) for r in roots.collect()) == [(1, "The good film", None), (2, "word", 2), (3, "bad odd", None)]


def test_reviews_keep_quoted_breaks_and_count_lines(spark, tmp_path):
    (tmp_path / "r.csv").write_text('5,"Title","two\nlines, ""quoted"""\n3,t,ok\n1,t,  \n7,t,odd\n2,t,bad\n')
    path = str(tmp_path / "r.csv")
    got = {(r.text, r.label, r.source) for r in readers.read_reviews(spark, path, 3).collect()}
    assert got == {('two\nlines, "quoted"', 1, "r.csv"), ("ok", 2, "r.csv"), ("bad", 0, "r.csv")}
    part = readers.read_reviews(spark, path, 3, line_range=(1, 4)).collect()
    assert [r.text for r in part] == ["ok"]


def test_vocabulary_repeats_keep_the_last_id(spark, tmp_path):
    (tmp_path / "v.txt").write_text("[PAD]\na\n##b\na\n")
    got = {r.token: r.id for r in readers.read_vocab(spark, str(tmp_path / "v.txt")).collect()}
    assert got == {"[PAD]": 0, "##b": 2, "a": 3}


def test_vocabulary_writer_flags_gaps(spark, tmp_path):
    whole = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id int")
    assert writers.write_vocab(whole, str(tmp_path / "whole"))
    assert not writers.write_vocab(whole.where("id = 1"), str(tmp_path / "gap"))


def test_tsv_round_trip_of_awkward_texts(spark, tmp_path):
    rows = [(1, 'a\tb\n"c"', "0", "s"), (2, " lead and trail ", "1", "s"), (3, "back\\slash", "2", "s"), (4, None, "1", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, source string")
    df = df.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test"), F.lit("train")), F.col("doc_id").cast("int")))
    writers.write_splits(df, str(tmp_path / "s"), ["doc_id", "text", "label", "source"])
    back = readers.read_splits(spark, str(tmp_path / "s"), df.drop("split").schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_annotated_sentences(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text(
        '{"sentence": "s1", "gold_label": "positive", "label_distribution": {"positive": ["w1", "w2"], "mixed": ["w3"], "negative": []}}\n'
        '{"sentence": "s2", "gold_label": null, "label_distribution": {"neutral": ["w1"]}}\n'
    )
    path = str(tmp_path / "d.jsonl")
    assert [tuple(r) for r in readers.read_jsonl_gold(spark, path).collect()] == [("s1", 1)]
    votes = sorted(tuple(r) for r in readers.explode_label_distribution(readers.read_jsonl(spark, path)).collect())
    assert votes == [("s1", 0, "w3"), ("s1", 1, "w1"), ("s1", 1, "w2"), ("s1", 1, "w3"), ("s2", 2, "w1")]


def test_polarity_files(spark, tmp_path):
    (tmp_path / "c.pos").write_text("good\n\n  \nfine\n")
    (tmp_path / "c.neg").write_text("bad\n")
    got = {(r.text, r.label) for r in readers.read_polarity_lines(spark, str(tmp_path)).collect()}
    assert got == {("good", 1), ("fine", 1), ("bad", 0)}
    for name in ("pos", "neg"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.txt").write_text(f"{name} line 1\nline 2")
    (tmp_path / "neg" / "2.txt").write_text(" \n")
    got = {(r.text, r.label) for r in readers.read_polarity_dirs(spark, str(tmp_path)).collect()}
    assert got == {("pos line 1\nline 2", 1), ("neg line 1\nline 2", 0)}


def test_polarity_folders_are_listed_as_such(spark, tmp_path, monkeypatch):
    """Two folders are looked up, whatever their files; one of them may have none, and tasks stay few."""
    for name in ("pos", "neg"):
        (tmp_path / name).mkdir()
    for i in range(200):
        (tmp_path / "pos" / f"{i}.txt").write_text(f"text {i}\n")
    (tmp_path / "pos" / "note.md").write_text("no example")
    monkeypatch.setattr(readers, "SMALL_FILE_TASKS", 0.5, raising=False)
    monkeypatch.setattr(readers, "task_count", lambda _: 4, raising=False)
    df = readers.read_polarity_dirs(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() <= 2
    assert sorted((r.text, r.label) for r in df.collect()) == sorted((f"text {i}\n", 1) for i in range(200))


def test_results_need_the_agreed_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.append_results(spark.range(1), str(tmp_path / "r"))


def test_run_names_and_missing_runs(spark):
    name = "../out/1-5_task_cola_ft_bert-base-uncased_data_wikitext-15M_seed_42_inoculation_1.0_lr_8e-05_reverse_False_random_True/"
    row = runs.parse_run_names(spark.createDataFrame([(name,)], "path string"), "path").first()
    assert (row.task, row.model, row.seed, row.learning_rate) == ("cola", "bert-base-uncased", 42, 8e-05)
    assert (row.midtuning, row.random_order, row.reverse_order, row.reinit_embedding) == (True, True, False, False)
    expected = spark.createDataFrame([("a/1-5_x_y/",), ("a/1-5_z/",)], "path string")
    done = spark.createDataFrame([("1-5_task_t_ft_x_y",)], "name string")
    assert [tuple(r) for r in runs.missing_runs(expected, "path", done, "name").collect()] == [("z", "a/1-5_z/")]


def test_line_numbers_over_several_files_and_stretches(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    want = {}
    for name, n in (("a", 700), ("b", 3), ("c", 2000)):
        lines = [f"{name} {i}" for i in range(n)]
        want |= {line: len(want) + i for i, line in enumerate(lines)}
        (folder / f"{name}.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = readers.with_line_numbers(spark.read.text(str(folder)))
        assert {r.value: r.line for r in df.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert readers.with_line_numbers(spark.read.text(str(folder)).where("false")).count() == 0
