"""Folders with one example in each file, listed and read by tasks."""

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader

from wordmill.sources import readers


def _folder(tmp_path):
    top = tmp_path / "a %20ü"
    for name in ("pos", "neg"):
        (top / name / "deeper").mkdir(parents=True)
        (top / name / "deeper" / "x.txt").write_text("too deep")
        for hidden in (".a.txt", "_a.txt", "a.text", "a.txt.bak"):
            (top / name / hidden).write_text("no example")
        (top / name / "_a=1.txt").write_text(f"{name} with a sign")
        (top / name / "sub.txt").mkdir()
        (top / name / "empty.txt").write_text("")
    for i in range(90):
        (top / "pos" / f"p {i}.txt").write_bytes(f"good {i}\r\nü\n".encode() + b"\xff")
    return str(top)


def test_the_driver_lists_no_files(spark, tmp_path, monkeypatch):
    folder = _folder(tmp_path)
    rows = lambda df: sorted((r.h, r.label) for r in df.select(F.hex("text").alias("h"), "label").collect())
    monkeypatch.setattr(readers, "_listed", lambda *_: None, raising=False)
    want = rows(readers.read_polarity_dirs(spark, folder))
    monkeypatch.undo()

    def listed(*_, **__):
        raise AssertionError("listed by the driver")

    monkeypatch.setattr(DataFrameReader, "text", listed)
    monkeypatch.setattr(readers, "HELD_BYTES", 40, raising=False)
    assert rows(readers.read_polarity_dirs(spark, folder)) == rows(readers.read_polarity_dirs(spark, f"file://{folder}")) == want
    assert len(want) == 92


def test_patterns_and_unknown_stores_are_left_to_the_driver(spark, tmp_path):
    folder = _folder(tmp_path)
    assert readers.read_polarity_dirs(spark, folder[:-1] + "?").count() == 92
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    (tmp_path / "b").mkdir()
    for name in ("pos", "neg"):
        (tmp_path / "b" / name).mkdir()
        (tmp_path / "b" / name / "1.txt").write_text(name)
    got = readers.read_polarity_dirs(spark, "viewfs://store/in/b").collect()
    assert sorted((r.text, r.label) for r in got) == [("neg", 0), ("pos", 1)]
