"""Readers of labelled text, vocabularies, maps and trees."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.functions import fixed
from wordmill.functions.hashing import hash_key
from wordmill.operators.scale import cumulated, settle, take_first, task_count
from wordmill.sources import delimited
from wordmill.sources.delimited import read_delimited

SPLIT_FILES = {"train": "train.tsv", "validation": "dev.tsv", "test": "test.tsv"}
#: Tasks that read very many small files, for each that a shuffle has.
SMALL_FILE_TASKS = 4
#: Files that a task reads at least, if there are so many, and bytes of them that it holds.
TASK_FILES, HELD_BYTES = 32, 4 << 20
_FILES = pa.schema([("store", pa.string()), ("path", pa.string())])
GOLD_SCHEMA = T.StructType(
    [
        T.StructField("sentence", T.StringType()),
        T.StructField("gold_label", T.StringType()),
        T.StructField("label_distribution", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)


def read_splits(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Train, dev and test TSV files with a header as one table with a ``split`` column."""
    parts = [
        read_delimited(spark, f"{folder}/{name}", schema, "\t", header=True).withColumn("split", F.lit(split))
        for split, name in SPLIT_FILES.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def with_line_numbers(df: DataFrame, name: str = "line") -> DataFrame:
    """0-based line numbers of a table just read from files, in the order of file and place.

    Tasks read stretches of files in order, so the text is written once as it comes, unsorted; a line's number is
    its place in its stretch plus the lines of earlier stretches, which are counted in a small table.
    """
    placed = settle(
        df.select(
            "*",
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "lines",
    )
    stretches = placed.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = cumulated(stretches, [F.col("_path"), F.col("_block")], "_n", "_before").drop("_n")
    line = F.col("_row") - F.col("_first") + F.col("_before")
    return placed.join(settle(before, "stretches"), ["_path", "_block"]).select(*df.columns, line.alias(name))


def read_reviews(
    spark: SparkSession,
    path: str,
    columns: int,
    label_map: dict[int, int] | None = None,
    line_range: tuple[int, int] | None = None,
    sample_size: int | None = None,
    seed: int = 42,
    source: str | None = None,
) -> DataFrame:
    """Star reviews without header: the rating is the first column, the text the last one.

    Ratings outside the label map and blank texts are dropped. ``line_range`` is half-open and counts
    lines of the file; ``sample_size`` rows are drawn by hash.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(columns)])
    found = delimited.records(spark, path, ",")
    if line_range is not None:
        first, last = line_range
        found = delimited.number(found).where((F.col("line") >= first) & (F.col("line") < last))
    rows = delimited.parsed(found, schema, ",")
    ids = fixed.STAR_LABELS if label_map is None else label_map
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    data = rows.select(
        F.col(f"c{columns - 1}").alias("text"),
        F.element_at(table, F.col("c0").cast("int")).alias("label"),
        F.lit(source or os.path.basename(path.rstrip("/"))).alias("source"),
    ).where(F.col("label").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}]"))
    if sample_size is None:
        return data
    return take_first(data, hash_key(seed, "text", "label"), ["text", "label"], sample_size)


def _polarity(path: Column, pattern: str) -> Column:
    return F.when(F.regexp_extract(path, pattern, 1) == "pos", fixed.POSITIVE).otherwise(fixed.NEGATIVE)


def read_polarity_lines(spark: SparkSession, folder: str, source: str = "custrev") -> DataFrame:
    """Every non-blank line of the ``*.pos`` and ``*.neg`` files is an example."""
    lines = spark.read.text([f"{folder}/*.pos", f"{folder}/*.neg"])
    label = _polarity(F.col("_metadata.file_path"), r"\.(pos|neg)(?:/[^/]*)?$")
    parts = lines.select(
        F.explode_outer(F.split("value", r"[\x0B\x0C\x1C\x1D\x1E\x85\x{2028}\x{2029}]")).alias("text"),
        label.alias("label"),
        F.lit(source).alias("source"),
    )
    return parts.where(F.col("text").rlike(r"[^\s\p{Z}]"))


def _listed(spark: SparkSession, folder: str) -> list[tuple[str, str]] | None:
    """``pos/`` and ``neg/`` as (store, path) if tasks can list and open them themselves, else None."""
    if re.search(r"[*?\[\]{}\\]", folder):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if uri.getScheme() == "file":
        return [("", f"{uri.getPath()}/{name}") for name in ("pos", "neg")]
    try:
        top = pafs.FileSystem.from_uri(uri.toString())[1]
    except (pa.ArrowException, OSError):
        return None
    return [(uri.toString(), f"{top}/{name}") for name in ("pos", "neg")]


def _store(uri: str) -> pafs.FileSystem:
    return pafs.FileSystem.from_uri(uri)[0] if uri else pafs.LocalFileSystem()


def _names(uri: str, path: str) -> Iterator[str]:
    """Plain files of a folder; those of a local one as they come, so that no list of them is held."""
    if uri:
        yield from (x.base_name for x in _store(uri).get_file_info(pafs.FileSelector(path)) if x.type == pafs.FileType.File)
        return
    with os.scandir(path) as found:
        yield from (x.name for x in found if x.is_file())


def _text_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``*.txt`` files of folders, without those that Spark takes for hidden."""
    for batch in batches:
        for row in batch.to_pylist():
            names = (x for x in _names(row["store"], row["path"]) if x.endswith(".txt") and x[0] != "." and (x[0] != "_" or "=" in x))
            while some := list(islice(names, 10_000)):
                yield pa.RecordBatch.from_pydict({"store": [row["store"]] * len(some), "path": [f"{row['path']}/{x}" for x in some]}, _FILES)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in the files, some megabytes at a time."""
    stores, held, size = {}, ([], []), 0

    def told() -> pa.RecordBatch:
        return pa.record_batch([pa.array(held[0], pa.string()), pa.array(held[1], pa.binary())], ["path", "value"])

    for batch in batches:
        for row in batch.to_pylist():
            store = stores.get(row["store"]) or stores.setdefault(row["store"], _store(row["store"]))
            with store.open_input_stream(row["path"], compression=None) as source:
                value = source.read()
            if held[0] and size + len(value) > HELD_BYTES:
                yield told()
                held, size = ([], []), 0
            held[0].append(row["path"])
            held[1].append(value)
            size += len(value)
    if held[0]:
        yield told()


def read_polarity_dirs(spark: SparkSession, folder: str, source: str = "imdb") -> DataFrame:
    """Every non-blank file below ``pos/`` and ``neg/`` is an example.

    One task lists each folder, the names are written as a table, and tasks open the files, so the driver holds no file's name, however many
    there are. Of a store that only Spark can open, and of folders given as a pattern, the driver lists the files: the two folders as such, because a
    pattern in the path would make each file a path of its own, looked up one by one. Spark's
    scan puts a few dozen small files into a task, so the tasks of very many files are put together.
    """
    most = int(SMALL_FILE_TASKS * task_count(spark))
    folders = _listed(spark, folder)
    if folders is None:
        files = spark.read.text([f"{folder}/pos", f"{folder}/neg"], wholetext=True, pathGlobFilter="*.txt")
        files = files.coalesce(most) if files.rdd.getNumPartitions() > most else files
        files = files.select("value", F.col("_metadata.file_path").alias("path"))
    else:
        places = spark.createDataFrame(spark.sparkContext.parallelize(folders, len(folders)), "store string, path string")
        names = settle(places.mapInArrow(_text_files, "store string, path string"), "files")
        tasks = max(1, min(most, names.count() // TASK_FILES))
        files = names.repartition(tasks).mapInArrow(_contents, "path string, value binary")
        files = files.select(F.col("value").cast("string").alias("value"), "path")
    label = _polarity(F.col("path"), r"/(pos|neg)/[^/]*$")
    return files.select(
        F.col("value").alias("text"), label.alias("label"), F.lit(source).alias("source")
    ).where(F.col("text").rlike(r"[^\s\p{Z}]"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD_SCHEMA).json(path)


def read_jsonl_gold(spark: SparkSession, path: str) -> DataFrame:
    """Annotated sentences with a known gold label."""
    table = F.create_map(*[F.lit(x) for pair in fixed.GOLD_LABELS.items() for x in pair])
    return (
        read_jsonl(spark, path)
        .select(F.col("sentence").alias("text"), F.element_at(table, F.col("gold_label")).alias("label"))
        .where("label is not null")
    )


def explode_label_distribution(df: DataFrame) -> DataFrame:
    """One row per annotator; a mixed vote counts once as positive and once as negative."""
    table = F.create_map(*[F.lit(x) for pair in fixed.GOLD_LABELS.items() for x in pair])
    votes = df.select("sentence", F.explode("label_distribution").alias("vote", "workers"))
    names = F.when(F.col("vote") == "mixed", F.array(F.lit("positive"), F.lit("negative"))).otherwise(
        F.array("vote")
    )
    return (
        votes.select("sentence", "workers", F.explode(names).alias("name"))
        .select("sentence", F.element_at(table, F.col("name")).alias("label"), F.explode("workers").alias("worker"))
        .select(F.col("sentence").alias("text"), "label", "worker")
    )


def tree_spans(
    df: DataFrame,
    key: str,
    line: str,
    include_subtrees: bool = True,
    classes: dict[str, int] | None = None,
) -> DataFrame:
    """Labelled phrases of bracketed trees: one row per subtree (or root), its leaves joined by spaces.

    The k-th opening bracket of a depth closes at the k-th closing bracket of that depth, so brackets meet
    in an equi-join; the phrase is a slice of the line's leaves.
    """
    ids = fixed.TREE_LABELS if classes is None else classes
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    marks = df.select(
        key, F.regexp_extract_all(line, F.lit(r"\([^\s()]*|\)|[^\s()]+"), F.lit(0)).alias("marks")
    ).repartition(key)
    leaves = marks.select(
        key, F.filter("marks", lambda m: ~m.startswith("(") & (m != ")")).alias("leaves")
    )
    each = marks.select(key, F.posexplode_outer("marks").alias("pos", "mark")).where("mark is not null")
    opens, closes = F.col("mark").startswith("("), F.col("mark") == ")"
    level, leaf = opens.cast("int") - closes.cast("int"), (~opens & ~closes).cast("int")
    running = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    walked = each.select(
        key,
        "pos",
        "mark",
        (F.sum(level).over(running) + closes.cast("int")).alias("depth"),
        F.sum(leaf).over(running).alias("n_leaves"),
    ).where(opens | closes)
    turn = W.partitionBy(key, "depth", closes).orderBy("pos")
    ranked = walked.withColumn("turn", F.row_number().over(turn))
    start = ranked.where(opens).select(
        key, "depth", "turn", F.col("pos").alias("node_id"), F.substring(F.col("mark"), F.lit(2), F.length("mark")).alias("tag"), F.col("n_leaves").alias("first")
    )
    end = ranked.where(closes).select(key, "depth", "turn", F.col("n_leaves").alias("last"))
    nodes = start.join(end, [key, "depth", "turn"])
    if not include_subtrees:
        nodes = nodes.where("depth = 1")
    return nodes.join(leaves, key).select(
        key,
        "node_id",
        "first",
        "last",
        F.array_join(F.slice("leaves", F.col("first") + 1, F.col("last") - F.col("first")), " ").alias("text"),
        F.element_at(table, F.col("tag")).alias("label"),
    )


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Word-piece vocabulary file: the id is the line number, a repeated token keeps its last id."""
    lines = with_line_numbers(spark.read.text(path), "id")
    return lines.groupBy(F.col("value").alias("token")).agg(F.max("id").cast("int").alias("id"))


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    """Table saved with one folder per split."""
    return spark.read.parquet(path)


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """Saved vocabulary, frequency table or substitution map."""
    return spark.read.parquet(path)


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Local table whose format is told by its extension: csv, tsv, json, jsonl or parquet."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind in ("csv", "tsv"):
        return read_delimited(spark, path, schema, "\t" if kind == "tsv" else ",", header=True)
    if kind in ("json", "jsonl"):
        return reader.json(path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unknown extension of {path}")
