"""WARC files as a Spark data source, and pages written to them with revisit records.

``spark.read.format("warc").load(path)`` plans one partition per file. Predicates on the record type and on the other
header columns are pushed into the reader, which parses a record's headers first and seeks past the block of a record
that a predicate rejects, or of every record with option ``payload=false``, without decoding it.
``df.write.format("warc")`` writes a file per task; a file gets its final name only when the whole job commits.

Of pages with equal payloads (of at least ``MIN_BYTES`` bytes) the one with the largest page_id is a response, the others
are revisits of it, which carry its id, the payload's digest and its length, but no payload.

Defined cases: a null html is an empty payload; a null page_id is below every other (in a group of nulls alone all are
responses); rows that repeat page_id and payload are alike; an empty table gives an empty result; further columns of
the pages are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import cut, fresh_path, open_fs, ship
from .graph import skew_join

MIN_BYTES = 0
#: Rows of the table of repeated payloads up to which it is broadcast (some 60 bytes each).
BROADCAST_ROWS = 200_000
RECORD = "page_id bigint, record_type string, target_uri string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f1c9b1e-7d54-4f5e-9d0a-0c6f2f6f2a11")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or with ``refers_to`` a revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"X-Payload-Length: {len(payload)}"]
    head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _number(x: str | None) -> int | None:
    return None if x is None else int(x)


def read_records(stream, wanted=lambda head: True, payload: bool = True) -> Iterator[dict]:
    """Records of a seekable binary stream. ``wanted`` sees the header columns; other records' blocks are skipped unread."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head.get("content-length", 0))
        row = {
            "page_id": _number(head.get("x-page-id")), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"),
            "payload_digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "payload_bytes": _number(head.get("x-payload-length")),
            "refers_to": _number(head.get("x-refers-to-page")), "payload": None}
        if not wanted(row) or not payload or row["record_type"] == "revisit":
            stream.seek(size + 4, 1)
            if wanted(row):
                yield row
            continue
        block = stream.read(size)
        stream.seek(4, 1)
        if head.get("content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        row |= {"payload": block, "payload_bytes": len(block), "payload_digest": digest32(block)}
        yield row


@dataclass
class WarcFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    temp: str
    final: str


class WarcReader(DataSourceReader):
    HEADERS = {"page_id", "record_type", "target_uri", "refers_to"}

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in self.HEADERS and isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((name, "in", {f.value}))
            elif name in self.HEADERS and isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif name in self.HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, "some", None))
            else:
                yield f

    def partitions(self) -> list[WarcFile]:
        from pyarrow import fs as pafs

        fs, where = open_fs(self.path)
        return [WarcFile(x.path) for x in sorted(fs.get_file_info(pafs.FileSelector(where)), key=lambda x: x.path) if x.path.endswith(".warc")]

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        tests = self.tests
        wanted = lambda row: all(row[n] in v if how == "in" else row[n] is not None for n, how, v in tests)
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        rows, size = [], 0
        batch = lambda rows: pa.record_batch({c: pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in rows[0]})
        with fs.open_input_file(partition.path) as stream:
            import io

            for row in read_records(io.BufferedReader(pa.PythonFile(stream, mode="r") if not hasattr(stream, "readinto") else stream, 1 << 20), wanted, self.payload):
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size > 8_000_000 or len(rows) >= 5_000:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, where = open_fs(self.path)
        fs.create_dir(where)
        name = uuid.uuid4().hex
        temp = f"{where}/_{name}.tmp"
        with fs.open_output_stream(temp) as out:
            for batch in iterator:
                cols = {n: batch.column(self.names.index(n)).to_pylist() for n in ("page_id", "url", "html", "refers_to")}
                for page_id, url, html, refers_to in zip(*cols.values(), strict=True):
                    out.write(make_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to))
        return Written(temp, f"{where}/{name}.warc")

    def commit(self, messages: list) -> None:
        fs, _ = open_fs(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.temp, m.final)

    def abort(self, messages: list) -> None:
        fs, _ = open_fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.temp)


class WarcSource(DataSource):
    """Columns when read: see RECORD. Columns needed to write: page_id, url, html, refers_to."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, refers_to: refers_to is null for pages to be written as responses."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html").withColumn("digest", F.unhex(F.sha1(payload)))
    many = rows.filter(F.octet_length(payload) >= min_bytes) if min_bytes else rows
    groups = cut(many.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "payload-groups")
    if groups.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(groups.drop("n")), "digest", "left")
    else:
        joined = skew_join(rows, groups, "digest", groups.agg(F.sum("n")).first()[0], "left")
    revisit = F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest"))
    return joined.select("page_id", "url", "html", revisit.alias("refers_to"))


def archive(pages: DataFrame, path: str | None = None) -> str:
    """Write ``pages`` as WARC files; returns their folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or fresh_path(spark, "warc")
    with_revisits(pages).write.format("warc").mode("append").save(path)
    return path


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def checked(spark: SparkSession, path: str) -> DataFrame:
    """The header columns of all records. Payloads of responses are read, and their length and digest taken from them; of revisits the
    headers alone are, with everything else pushed down to the reader and skipped."""
    columns = [c.split()[0] for c in RECORD.split(", ")][:-1]
    responses = read(spark, path).filter("record_type = 'response'").select(*columns)
    return responses.unionByName(read(spark, path, payload=False).filter("record_type = 'revisit'").select(*columns))
