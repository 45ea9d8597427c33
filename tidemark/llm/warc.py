"""Operator 8: WARC archives, written and read back sequentially.

One gzip member holds one record: header lines, an empty line, a block of the length that Content-Length states, two
line ends. Of pages with equal payloads the one with the largest id is stored as response; others are revisit records
that refer to it and carry no payload, only its digest and length. The reader goes through an archive once: it
decompresses incrementally, member by member, frames each record by its lengths, and compares the digest of every
payload with the one that the header states.

Archives of about ARCHIVE_BYTES are rows with a binary column, so Spark's own readers and writers move them in any
store; ``write_files`` writes them as ordinary .warc.gz files through a Python data source, whose tasks write under
names of their own and whose driver keeps those of the tasks that were committed; ``read_files`` reads such files
through Spark's binaryFile source.

Defined cases: a null page counts as an empty payload, a null id is written as empty and counts as smaller than any
other; among pages that repeat id and payload all with the largest id are responses; a payload longer than an archive
makes an archive of its own; control characters in a URL are percent-encoded; an empty table gives no archive and no record. A record whose digest differs or whose framing is
broken raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import table, use_shared_folder

#: Compressed bytes from which an archive is closed.
ARCHIVE_BYTES = 4_000_000
LEVEL = 4
#: What the reader decompresses at once.
STEP = 65_536
DATE = "2000-01-01T00:00:00Z"  # records are reproducible: no clock

ARCHIVES = "archive_id string, n_records long, content binary"
RECORDS = "archive_id string, record_type string, record_id string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_ARCHIVES = pa.schema([("archive_id", pa.string()), ("n_records", pa.int64()), ("content", pa.binary())])
_RECORDS = [("archive_id", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def _id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record, before compression."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_id(page_id, digest)}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        *([f"WARC-Refers-To: {_id(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(content: bytes) -> Iterator[bytes]:
    """The decompressed bytes of each gzip member, one member at a time."""
    at, n = 0, len(content)
    while at < n:
        inflater, out = zlib.decompressobj(31), []
        while not inflater.eof:
            if at >= n:
                raise ValueError("the archive ends inside a gzip member")
            out.append(inflater.decompress(content[at : at + STEP]))
            at += STEP
        at = min(at, n) - len(inflater.unused_data)
        yield b"".join(out)


def parse(member: bytes) -> dict[str, object]:
    """Header fields in lower case, and the block as framed by Content-Length; digests are verified."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *fields = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    got: dict[str, object] = {}
    for field in fields:
        name, _, value = field.partition(":")
        got[name.strip().lower()] = value.strip()
    length = int(str(got["content-length"]))
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's length differs from its Content-Length")
    stated = got.get("warc-block-digest")
    if stated and stated != f"sha1:{digest32(block)}":
        raise ValueError("the block's digest differs from the stated one")
    got["block"] = block
    return got


def _page(record_id: str) -> int | None:
    parts = record_id.strip("<>").split(":")
    return int(parts[2]) if parts[:2] == ["urn", "page"] and parts[2:3] not in ([], [""]) else None


def _row(archive_id: str, member: bytes) -> tuple:
    got = parse(member)
    block = bytes(got["block"])
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    stated = str(got.get("warc-payload-digest", "")).removeprefix("sha1:")
    kind, n = str(got.get("warc-type", "")), int(lengths[0]) if lengths else len(payload)
    if kind == "response":
        if n != len(payload):
            raise ValueError("the payload's length differs from the stated one")
        if stated and stated != digest32(payload):
            raise ValueError("the payload's digest differs from the stated one")
    refers = got.get("warc-refers-to")
    record_id = str(got.get("warc-record-id", ""))
    return archive_id, kind, record_id, _page(record_id), got.get("warc-target-uri"), stated, n, _page(str(refers)) if refers else None, payload


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to: the largest id among equal payloads of at least ``least`` bytes, null for that itself.

    Only digests and ids are grouped. The join is on the digests that several rows have, whose large groups Spark can
    split; all other rows go by without a partner.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    groups = rows.filter(F.length("payload") >= least).groupBy("sha1").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n"))
    shared = groups.filter("n > 1 and last_id is not null").select("sha1", "last_id")
    joined = rows.join(shared, "sha1", "left")
    revisits = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    return joined.select("page_id", "url", "payload", F.when(revisits, F.col("last_id")).alias("refers_to"))


def pack(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of the rows that ``with_revisits`` gives; each task writes its own, in the order of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        held = 0

        def archive() -> pa.RecordBatch:
            content = b"".join(parts)
            name = hashlib.sha256(content).hexdigest()[:32]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(parts)]), pa.array([content], pa.binary())], schema=_ARCHIVES)

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*batch.columns, strict=True):
                body = payload.as_py()
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                part = packer.compress(record(page_id.as_py(), url.as_py(), body, digest32(body), refers_to.as_py())) + packer.flush()
                parts.append(part)
                held += len(part)
                if held >= archive_bytes:
                    yield archive()
                    parts, held = [], 0
        if parts:
            yield archive()

    return rows.mapInArrow(run, ARCHIVES)


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives (columns archive_id, content); payload is null if not asked for."""
    schema = pa.schema(_RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                rows, held = [], 0
                for member in members(content.as_py()):
                    row = _row(name.as_py(), member)
                    rows.append(row if payloads else (*row[:-1], None))
                    held += len(member) if payloads else 200
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.select("archive_id", "content").mapInArrow(run, RECORDS)


def read_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of .warc.gz files, by any path that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return read(files.select(F.col("path").alias("archive_id"), "content"), payloads)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcFiles(DataSource):
    """Sink of archives (archive_id, content) as files in a folder that all tasks reach."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options["path"], schema.fieldNames())


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def folder(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, folder = self.folder()
        store.create_dir(f"{folder}/_tasks", recursive=True)
        task, names = uuid.uuid4().hex, []
        for k, row in enumerate(iterator):
            name = f"{row[self.names.index('archive_id')]}-{task}-{k}.warc.gz"
            with store.open_output_stream(f"{folder}/_tasks/{name}", compression=None) as out:
                out.write(bytes(row[self.names.index("content")]))
            names.append(name)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = self.folder()
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{folder}/_tasks/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What tasks left that weren't committed goes."""
        store, folder = self.folder()
        if store.get_file_info(f"{folder}/_tasks").type != fs.FileType.NotFound:
            store.delete_dir(f"{folder}/_tasks")


def write_files(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """The pages as .warc.gz files in a folder, a path or address that pyarrow's file systems open."""
    pages.sparkSession.dataSource.register(WarcFiles)
    pack(with_revisits(pages), archive_bytes).select("archive_id", "content").write.format("warc").mode("append").option("path", path).save()


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    pack(with_revisits(pages), archive_bytes).write.option("compression", "none").mode("overwrite").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    records = read(spark.read.schema(ARCHIVES).parquet(path), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
