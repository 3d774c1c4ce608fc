"""Delimited text whose quoted fields hold line breaks, read by many tasks even from one file.

A line break ends a record only outside quotes, and whether a byte lies inside quotes depends on all text before it. Spark's
scan deals a file out in stretches of whole lines. The first pass tells, for each stretch, in which state it is left when it is entered
outside and inside a quoted field; folding these small tables in file order gives the state in which every
stretch is entered. The second pass then cuts all stretches into records at the same time. A record that goes on in the next stretch
is put together from its pieces, of which a stretch has at most two. Parsing the fields is left to Spark.

Quotes count as Spark's parser counts them: they open a field only at its start, are doubled inside, and text between the
closing quote and the separator belongs to the field. Lines end in a line feed, with or without a carriage return; inside quotes both are kept.
Empty lines are no records.
"""

from __future__ import annotations

import csv
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.operators.scale import cumulated, is_small, settle

QUOTE = '"'
#: The rest of a quoted field, up to its closing quote.
QUOTED = re.compile(r'[^"]*+(?:""[^"]*+)*+')
#: Options of the parser that gets one record at a time.
PARSER = {"quote": QUOTE, "escape": QUOTE, "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted field is open behind the line, given whether one is open before it."""
    if QUOTE not in line:
        return inside
    at = 0
    while True:
        if inside or line.startswith(QUOTE, at):
            at = QUOTED.match(line, at if inside else at + 1).end()
            if at == len(line):
                return True
            at += 1
        # past a quoted field, or in a plain one
        inside, at = False, line.find(sep, at) + 1
        if not at:
            return False


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines in the order of the scan: value, path, block (where the stretch begins), row."""
    text = spark.read.text(path, lineSep="\n")
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    return text.select("value", *place, F.monotonically_increasing_id().alias("row"))


def stretches(rows: DataFrame, sep: str) -> DataFrame:
    """For each stretch (path, block) whether it is entered inside a quoted field."""

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states = None, [False, True]

        def told() -> pa.RecordBatch:
            columns = [pa.array([x], t) for x, t in zip((*now, *states), (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))]
            return pa.record_batch(columns, ["path", "block", "from_outside", "from_inside"])

        for batch in batches:
            for value, *at in zip(*(batch[c].to_pylist() for c in ("value", "path", "block"))):
                if at != now:
                    if now is not None:
                        yield told()
                    now, states = at, [False, True]
                if QUOTE in value:
                    states = [inside_after(value, s, sep) for s in states]
        if now is not None:
            yield told()

    left = settle(rows.mapInArrow(leave, "path string, block long, from_outside boolean, from_inside boolean"), "stretches")
    # the state behind a stretch is settled by the last one that leaves both states alike, then by the changes since
    order = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    fixed = F.col("from_outside") == F.col("from_inside")
    turns = F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int")).over(order)
    known = F.last(F.when(fixed, F.struct(F.col("from_outside").alias("state"), F.col("turns").alias("turns"))), ignorenulls=True).over(order)
    counted = left.withColumn("turns", F.coalesce(turns, F.lit(0)))
    entered = counted.withColumn("known", known).withColumn("since", F.col("turns") - F.coalesce("known.turns", F.lit(0)))
    # the turns counted at a fixed stretch lie before it, and the stretch itself is no turn
    state = F.coalesce("known.state", F.lit(False)) != (F.col("since") % 2 == 1)
    return settle(entered.select("path", "block", state.alias("inside")), "entered")


def records(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """Records of delimited files: text, path, block, n (place among the records that begin in the stretch, from 0)."""
    rows = lines(spark, path)
    entered = stretches(rows, sep)
    if is_small(entered):
        placed = rows.join(F.broadcast(entered), ["path", "block"])  # keeps the order of the scan
    else:
        placed = rows.join(entered, ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "row")
    schema = "path string, block long, n long, text string, begins boolean, ends boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, begins, n, held = None, False, True, 0, []

        def piece(ends: bool) -> tuple:
            return (*now, n, "\n".join(held), begins, ends)

        for batch in batches:
            out = []
            for value, entry, *at in zip(*(batch[c].to_pylist() for c in ("value", "inside", "path", "block"))):
                if at != now:
                    if held:
                        out.append(piece(False))
                    now, inside, begins, n, held = at, entry, not entry, 0, []
                inside = inside_after(value, inside, sep)
                if held or value.rstrip("\r") or inside or not begins:
                    held.append(value)
                    if not inside:
                        out.append(piece(True))
                        n += begins
                        begins, held = True, []
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["path", "block", "n", "text", "begins", "ends"])
        if held:
            yield pa.record_batch([pa.array([x]) for x in piece(False)], ["path", "block", "n", "text", "begins", "ends"])

    pieces = placed.select("value", "inside", "path", "block").mapInArrow(cut, schema)
    # whole records go on from here; of the text only what stretches cut in two is written
    whole = pieces.where("begins AND ends")
    parts = settle(pieces.where("NOT begins OR NOT ends"), "parts")
    # a record in pieces: its beginning and all pieces up to the next beginning, in file order
    order = W.partitionBy("path").orderBy("block", "begins", "n")
    group = F.sum(F.col("begins").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    joined = parts.withColumn("g", group).groupBy("path", "g").agg(
        F.min(F.when(F.col("begins"), F.struct("block", "n"))).alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "begins", "text"))), lambda x: x["text"]), "\n").alias("text"),
    )
    columns = ["text", "path", "block", "n"]
    every = whole.select(*columns).unionByName(joined.select("text", "path", "first.block", "first.n"))
    return every.withColumn("text", F.regexp_replace("text", r"\r\z", ""))


def number(found: DataFrame, name: str = "line") -> DataFrame:
    """Records with their number (from 0) over all files, in the order of file and place."""
    counts = found.groupBy("path", "block").agg(F.count("*").alias("many"))
    before = settle(cumulated(counts, [F.col("path"), F.col("block")], "many", "before").drop("many"), "before")
    joined = found.join(F.broadcast(before) if is_small(before) else before, ["path", "block"])
    return joined.withColumn(name, F.col("n") + F.col("before")).drop("before")


def parsed(found: DataFrame, schema: T.StructType, sep: str, keep: list[str] | None = None) -> DataFrame:
    """Fields of every record, and the columns to keep."""
    fields = F.from_csv("text", schema.toDDL(), PARSER | {"sep": sep})
    return found.select(fields.alias("fields"), *(keep or [])).select("fields.*", *(keep or []))


def header_names(found: DataFrame, sep: str) -> list[str]:
    """Column names of the first file's first record, as Spark names them."""
    first = found.where("block = 0 AND n = 0").orderBy("path").select("text").first()
    names = next(csv.reader([first["text"].removeprefix("﻿")], delimiter=sep)) if first else []
    names = [x or f"_c{i}" for i, x in enumerate(names)]
    low = [x.lower() for x in names]
    return [x + str(i) if low.count(x.lower()) > 1 else x for i, x in enumerate(names)]


def read_delimited(spark: SparkSession, path: str | list[str], schema: T.StructType | None, sep: str, header: bool) -> DataFrame:
    """Delimited files as a table; without a schema all columns are text, named by the header."""
    found = records(spark, path, sep)
    if schema is None:
        schema = functools.reduce(lambda s, x: s.add(x, T.StringType()), header_names(found, sep), T.StructType())
    if header:
        found = found.where("NOT (block = 0 AND n = 0)")
    return parsed(found, schema, sep)
