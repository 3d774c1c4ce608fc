"""WARC archives as a PySpark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: every task writes one archive; the driver's commit lists the archives, with record offsets about every
``stride`` bytes, in ``_index.json``. What a failed or repeated attempt leaves behind is not listed and never read.

Reading: partitions are stretches of archives that start at listed offsets (an archive without index is one
partition). Predicates on the record type and on header columns are taken over from Spark and judged on the parsed headers;
the block of a record that fails them, or of any record when ``payload`` is ``false``, is skipped by its Content-Length
without being read or decoded. Folders may be local, or of any store that pyarrow's file systems open.

Defined cases: an empty input writes an index without archives, which reads as no rows; null payloads are written as
empty ones, null fields as absent headers (they read as null); line breaks in header values become blanks; a record cut off at the
end of an archive is an error; names in headers are matched without regard to case, the last of repeated ones counts.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from wordmill.llm.common import settle

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_type string, content_length long, payload_length long, payload binary"
)
#: Columns that are WARC headers as they stand.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
NAMES = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
INDEX = "_index.json"
STRIDE = 32 << 20
BATCH = 8 << 20


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a path or a URI."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(urlparse(folder).path)
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


# ---- records


def encoded(row: dict) -> bytes:
    """One record: WARC headers, HTTP headers, payload (a revisit has none), two line ends."""
    payload = row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http if row["record_type"] == "revisit" else http + payload
    lines = ["WARC/1.1", *(f"{name}: {' '.join(str(row[column]).split())}" for column, name in NAMES.items() if row[column] is not None)]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += [f"Content-Type: {HTTP}", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parsed(source: io.BufferedIOBase) -> dict[str, str] | None:
    """Headers of the record that starts here, names in small letters; None at the end."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    found: dict[str, str] = {}
    while (line := source.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("archive ends inside a header")
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """Length of the full payload, and the payload itself unless the record is a revisit."""
    if not headers.get("content-type", "").startswith("application/http"):
        return len(block), block
    head, _, body = block.partition(b"\r\n\r\n")
    if headers.get("warc-type") != "revisit":
        return len(body), body
    said = [x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return int(said[-1]) if said else 0, None


# ---- predicates on headers


def judge(f: Filter, value: str | int | None) -> bool:
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return value.endswith(f.value)
    if isinstance(f, StringContains):
        return f.value in value
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, GreaterThan):
        return value > f.value
    if isinstance(f, GreaterThanOrEqual):
        return value >= f.value
    if isinstance(f, LessThan):
        return value < f.value
    return value <= f.value


TAKEN = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


# ---- reading


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int | None


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payload: bool) -> None:
        self.folder, self.payload = folder, payload
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, TAKEN) and len(f.attribute) == 1 and f.attribute[0] in (*HEADERS, "content_length"):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        fs, path = opened(self.folder)
        index = f"{path}/{INDEX}"
        if fs.get_file_info(index).type == pafs.FileType.File:
            with fs.open_input_stream(index) as source:
                archives = json.loads(source.read())
            cuts = [(a["name"], [*a["offsets"], a["size"]]) for a in archives]
            return [Stretch(f"{self.folder.rstrip('/')}/{name}", a, b) for name, at in cuts for a, b in zip(at[:-1], at[1:], strict=True)]
        files = fs.get_file_info(pafs.FileSelector(path)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
        found = sorted(f.base_name for f in files if f.base_name.endswith((".warc", ".warc.gz")))
        top = self.folder.rstrip("/") if fs.get_file_info(path).type == pafs.FileType.Directory else self.folder.rpartition("/")[0]
        return [Stretch(f"{top}/{name}", 0, None) for name in found]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in SCHEMA.split(", ")])
        if partition is None:
            return
        fs, path = opened(partition.path)
        rows, held = [], 0
        with fs.open_input_file(path) as raw:
            raw.seek(partition.start)
            packed = path.endswith(".gz")
            source = gzip.open(raw) if packed else io.BufferedReader(raw, 1 << 18)
            while partition.end is None or source.tell() < partition.end:
                headers = parsed(source)
                if headers is None:
                    break
                length = int(headers["content-length"])
                row = {column: headers.get(name) for column, name in HEADERS.items()} | {"content_length": length, "payload_length": None, "payload": None}
                if not all(judge(f, row[f.attribute[0]]) for f in self.filters) or not self.payload and headers.get("warc-type") != "revisit":
                    if all(judge(f, row[f.attribute[0]]) for f in self.filters):
                        rows.append(row)
                    source.seek(length + 4, io.SEEK_CUR)
                else:
                    block = source.read(length)
                    if len(block) < length:
                        raise ValueError("archive ends inside a record")
                    source.seek(4, io.SEEK_CUR)
                    row["payload_length"], row["payload"] = payload_of(headers, block)
                    rows.append(row)
                    held += length
                if held > BATCH or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


# ---- writing


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    offsets: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, stride: int, overwrite: bool) -> None:
        self.folder, self.stride, self.overwrite = folder, stride, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        fs, path = opened(self.folder)
        name, size, offsets = f"part-{uuid.uuid4().hex}.warc", 0, [0]
        sink = None
        for batch in iterator:
            for i in range(batch.num_rows):
                if sink is None:
                    fs.create_dir(path)
                    sink = fs.open_output_stream(f"{path}/{name}", buffer_size=1 << 20)
                if size - offsets[-1] >= self.stride:
                    offsets.append(size)
                record = encoded(batch.slice(i, 1).to_pylist()[0])
                sink.write(record)
                size += len(record)
        if sink is None:
            return Written("", 0, [])
        sink.close()
        return Written(name, size, offsets)

    def commit(self, messages: list[Written | None]) -> None:
        """List the new archives, after those of earlier writes or, when overwriting, in their place.

        The index is written aside and takes the old one's name at once, so readers see either state. Archives that
        no longer count are deleted last.
        """
        fs, path = opened(self.folder)
        fs.create_dir(path)
        index, aside = f"{path}/{INDEX}", f"{path}/{INDEX}.{uuid.uuid4().hex}"
        before = []
        if fs.get_file_info(index).type == pafs.FileType.File:
            with fs.open_input_stream(index) as source:
                before = json.loads(source.read())
        listed = [{"name": m.name, "size": m.size, "offsets": m.offsets} for m in messages if m is not None and m.name]
        with fs.open_output_stream(aside) as sink:
            sink.write(json.dumps(listed if self.overwrite else before + listed).encode())
        fs.move(aside, index)
        for archive in before if self.overwrite else []:
            fs.delete_file(f"{path}/{archive['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing to do: archives that no index lists are not read."""


class WarcSource(DataSource):
    """Options: ``path``; ``payload`` (true) and, for writing, ``stride`` in bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema: object, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("stride", STRIDE)), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let Spark hand predicates to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---- pages


def records(pages: DataFrame, least: int = 1000, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Records of pages: of equal payloads of at least ``least`` bytes, the one with the largest key is the response.

    Only payloads that occur more than once take part in the join that finds it, and only by their digest; the table of these is
    written first, so Spark broadcasts it if it is small and otherwise splits a digest that very many pages share.
    A null key never beats another; repeated rows of the largest key are all responses.
    """
    raw = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    )
    told = raw.withColumn("payload_length", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    shared = told.where(F.col("payload_length") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    shared = settle(shared.where("n > 1").select("digest", "first"), "shared")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return told.join(shared, "digest", "left").select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"),
        F.lit(HTTP).alias("content_type"),
        F.lit(None).cast("long").alias("content_length"),
        "payload_length",
        F.when(again, F.lit(None).cast("binary")).otherwise(F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, folder: str, mode: str = "append") -> None:
    """Records as archives of a folder, added to those it has (``append``) or in their place (``overwrite``)."""
    register(pages.sparkSession)
    pages.write.format("warc").mode(mode).save(folder)


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
    d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS payload_digest FROM p),
    g AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
    SELECT d.page_id, payload_bytes, d.payload_digest,
        CASE WHEN d.page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN d.page_id < first THEN first END AS refers_to
    FROM d LEFT JOIN g USING (payload_digest)"""
