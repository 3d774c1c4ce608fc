"""Delimited files with quoted line breaks, read in many stretches, against Spark's one-task reader."""

import random

import pytest
from pyspark.sql import types as T

from wordmill.sources import delimited, readers, writers

SCHEMA = T.StructType().add("a", T.StringType()).add("b", T.StringType()).add("n", T.IntegerType())
ONE_TASK = {"quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def content(sep, end, seed):
    rng = random.Random(seed)
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    fields = ["plain", "", 'say "hi"', "two" + end + "lines", end + end, 'a"b', sep + "x", '"', "é日本", " spaced ", "None", 'end"']
    rows = [f"a{sep}b{sep}n"]
    for i in range(100):
        x, y = rng.choice(fields), rng.choice(fields)
        plain = lambda v: not v.startswith('"') and end not in v and "\n" not in v and sep not in v
        rows.append(sep.join([x if plain(x) and rng.random() < 0.5 else quoted(x), y if plain(y) and rng.random() < 0.5 else quoted(y), str(i)]))
        if rng.random() < 0.05:
            rows.append("")
    return end.join(rows) + (end if seed % 2 else "")


@pytest.fixture
def short_stretches(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "499")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize(("sep", "end", "seed"), [("\t", "\n", 1), (",", "\n", 2), (",", "\r\n", 3)])
def test_same_rows_as_one_task(spark, tmp_path, short_stretches, sep, end, seed):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.csv").write_bytes(content(sep, end, seed + 10 * k).encode())
    got = delimited.read_delimited(spark, str(folder), SCHEMA, sep, header=True)
    want = spark.read.csv(str(folder), sep=sep, header=True, schema=SCHEMA, **ONE_TASK)
    # that reader makes the line breaks of a file alike, this one keeps those inside quotes as they are
    like = lambda r: tuple(v.replace("\r\n", "\n") if isinstance(v, str) and end == "\r\n" else v for v in r)
    rows = sorted((like(r) for r in got.collect()), key=str)
    assert rows == sorted((like(r) for r in want.collect()), key=str) and len(rows) == 200
    assert delimited.lines(spark, str(folder)).rdd.getNumPartitions() > 6


def test_records_are_numbered_in_file_order(spark, tmp_path, short_stretches):
    (tmp_path / "r.csv").write_text("".join(f'{i % 5 + 1},"text\n{i}"\n' + ("\n" if i % 7 == 0 else "") for i in range(300)))
    found = delimited.number(delimited.records(spark, str(tmp_path / "r.csv"), ","))
    got = {r["line"]: r["text"] for r in found.collect()}
    assert got == {i: f'{i % 5 + 1},"text\n{i}"' for i in range(300)}
    reviews = readers.read_reviews(spark, str(tmp_path / "r.csv"), 2, line_range=(10, 20)).collect()
    assert sorted(r["text"] for r in reviews) == sorted(f"text\n{i}" for i in range(10, 20))


def test_a_record_over_many_stretches(spark, tmp_path, short_stretches):
    text = "\n".join(f"line {i}" for i in range(300))
    (tmp_path / "r.tsv").write_text(f'a\tb\tn\nx\t"{text}"\t1\ny\tz\t2\n')
    got = readers.read_any(spark, str(tmp_path / "r.tsv"), SCHEMA).orderBy("n").collect()
    assert [tuple(r) for r in got] == [("x", text, 1), ("y", "z", 2)]
    named = readers.read_any(spark, str(tmp_path / "r.tsv"))
    assert named.columns == ["a", "b", "n"] and named.count() == 2


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert delimited.read_delimited(spark, str(tmp_path / "e.csv"), SCHEMA, ",", header=True).collect() == []


def test_round_trip_of_splits(spark, tmp_path):
    rows = [('tab\there "q"\nnext\r\nend', "x", 1, s) for s in ("train", "validation", "test")] + [("None", " y ", 2, "train")]
    writers.write_splits(spark.createDataFrame(rows, "a string, b string, n int, split string"), str(tmp_path), ["a", "b", "n"])
    assert sorted(tuple(r) for r in readers.read_splits(spark, str(tmp_path), SCHEMA).collect()) == sorted(rows)


def test_inside_after():
    for line, outside, inside in [("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('x","y', True, True), ('""', False, True), ('a,"b""', True, False), ('""",c', True, False)]:
        assert (delimited.inside_after(line, False, ","), delimited.inside_after(line, True, ",")) == (outside, inside), line


def test_only_records_cut_in_two_are_written(spark, tmp_path, monkeypatch):
    rows = [f'"x{i} ""y""","b{i}",{i}' for i in range(400)]
    (tmp_path / "t.csv").write_text("\n".join(rows) + "\n")
    written = []
    real = delimited.settle
    monkeypatch.setattr(delimited, "settle", lambda df, name: written.append((name, made := real(df, name))) or made)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = readers.read_delimited(spark, str(tmp_path / "t.csv"), SCHEMA, ",", False).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got)) == sorted((f'x{i} "y"', f"b{i}", i) for i in range(400))
    assert all(df.count() < 100 for _, df in written)
