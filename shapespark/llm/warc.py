"""WARC archives as a PySpark Python data source.

Reading plans partitions from files (small files share one), parses each record's headers first, and applies pushed predicates on the record
type, the target and the digest to them; what they rule out is skipped by its length, and payloads are only read if they are asked for
(option payload) or to be verified against their digest (option verify). Writing gives each task files of its own, rolled over at
FILE_BYTES, which the driver's commit renames into place; an attempt that is lost leaves nothing that is read.

Files are reached through pyarrow's file systems, so a path may be a local one, file://, hdfs:// (where its native library is installed),
s3:// or gs://.

Of records with equal payloads of at least `least` bytes, the one with the smallest page_id is written as a response and the others as
revisits that refer to it.

Archives of others: a payload is what follows the HTTP head, with a chunked transfer undone; payload_bytes is its length in bytes (of a record
that isn't read, and of one that the file cuts off, as declared; of a revisit, that of the payload it refers to, or null); a head without an
empty line ends with its record; record ids stay in record_id and refers_to_id, and page_id is null if they aren't ours; digests other than
SHA-1 aren't verified; a record without a length, or what doesn't start a record, is an error.

Defined cases: null html is an empty payload; a very long payload is one record of its own length; a null url is left out of the headers; rows that share a page_id each get a record, and those
that also share the payload of a response are responses; a null page_id refers to the smallest known one, or is a response if all of its
group are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .shared import BROADCAST_BYTES, bounded_batches, materialise, scratch_path, table

#: Size at which a writer starts another file, and of what a reading task gets in small files.
FILE_BYTES = 32 << 20
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
READ = "page_id long, record_type string, target_uri string, refers_to long, payload_digest string, payload_bytes long, payload binary, record_id string, refers_to_id string"
WRITE = "page_id long, target_uri string, payload binary, sha1 string, refers_to long"
#: Columns on which predicates are pushed down.
PUSHED = ("record_type", "target_uri", "payload_digest", "page_id", "refers_to", "record_id", "refers_to_id")
#: The longest line of a head that is read; what follows is skipped.
LINE = 1 << 16
OWN_ID = re.compile(r"<urn:page:(-?[0-9]{1,18})>")


def record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit"}
    if page_id is not None:
        head["WARC-Record-ID"] = f"<urn:page:{page_id}>"
    if uri is not None:
        head["WARC-Target-URI"] = uri.replace("\r", "%0D").replace("\n", "%0A")
    head |= {"WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head.items()), b"\r\n", block, b"\r\n\r\n"])


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        files, out = [], None
        try:
            for batch in iterator:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    page_id, uri, payload, sha1, refers_to = row
                    if out is None:
                        files.append(posixpath.join(root, f"_attempt-{uuid.uuid4().hex}.warc"))
                        out = system.open_output_stream(files[-1])
                    out.write(record(page_id, uri, payload or b"", base32(sha1), refers_to))
                    if out.tell() >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for found in system.get_file_info(fs.FileSelector(root)):
                if found.base_name.endswith((".warc", ".warc.gz")) and not found.base_name.startswith("_"):
                    system.delete_file(found.path)
        for n, file in enumerate(f for m in messages if m for f in m.files):
            system.move(file, posixpath.join(root, f"{uuid.uuid4().hex[:8]}-{n:06d}.warc"))

    def abort(self, messages: list) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for file in (f for m in messages if m for f in m.files):
            system.delete_file(file)


@dataclass
class Files(InputPartition):
    files: list[str]


def _number(urn: str | None) -> int | None:
    """The page_id in one of our own record ids; others have none."""
    found = OWN_ID.fullmatch(urn or "")
    return int(found[1]) if found else None


def _line(source, most: int) -> bytes:
    """The next line, of `most` bytes at most."""
    return source.readline(min(most, LINE)) if most > 0 else b""


def _headers(source) -> dict[str, str] | None:
    """The named fields of the next record, or None at the end."""
    line = source.readline(LINE)
    while line in (b"\r\n", b"\n"):
        line = source.readline(LINE)
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
    return _fields(source, 1 << 62)[0]


def _fields(source, left: int) -> tuple[dict[str, str], int]:
    """Named fields up to an empty line or the end of a block of `left` bytes, and what is left of it. Lines that start with a space go on."""
    out: dict[str, str] = {}
    name = ""
    while line := _line(source, left):
        left -= len(line)
        while not line.endswith(b"\n") and (more := _line(source, left)):  # a longer line
            left -= len(more)
            if more.endswith(b"\n"):
                break
        if not line.strip():
            break
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and name:
            out[name] = f"{out[name]} {text.strip()}"
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        out[name] = value.strip()
    return out, left


def _length(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() else None


def unchunked(data: bytes) -> bytes:
    """The body of a chunked transfer; as it is if it isn't one, up to where it breaks off."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n", at, at + 1024)
        size = data[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return b"".join(out) + data[at:] if out else data
        n = int(size, 16)
        if n == 0:
            break
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n
        at += 2 * (data[at : at + 2] == b"\r\n")
    return b"".join(out)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in PUSHED:
                self.tests.append((f.attribute[0], "in", (f.value,)))
            elif isinstance(f, In) and f.attribute[0] in PUSHED:
                self.tests.append((f.attribute[0], "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute[0] in PUSHED:
                self.tests.append((f.attribute[0], "starts", f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = sorted((i.path, i.size) for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.base_name.endswith((".warc", ".warc.gz")) and not i.base_name.startswith("_"))
        parts, held = [], 0
        for path, n in found:
            if not parts or held + n > FILE_BYTES:
                parts.append(Files([]))
                held = 0
            parts[-1].files.append(path)
            held += n
        return parts or [Files([])]

    def wanted(self, row: dict) -> bool:
        return all(row[c] is not None and (row[c] in value if how == "in" else row[c].startswith(value)) for c, how, value in self.tests)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.files:
            with system.open_input_file(path) as raw:
                source = gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 18)
                while (head := _headers(source)) is not None:
                    left = _length(head.get("content-length"))
                    if left is None:
                        raise ValueError(f"{path}: a record without a length")
                    ids = head.get("warc-record-id"), head.get("warc-refers-to")
                    row = {
                        "page_id": _number(ids[0]), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "refers_to": _number(ids[1]),
                        "payload_digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "record_id": ids[0], "refers_to_id": ids[1],
                    }
                    if self.wanted(row):
                        payload, length = self.body(source, head, left, f"{path}: {ids[0]}")
                        yield row["page_id"], row["record_type"], row["target_uri"], row["refers_to"], row["payload_digest"], length, payload if self.payload else None, *ids
                    else:
                        _skip(source, left)

    def body(self, source, head: dict[str, str], left: int, name: str) -> tuple[bytes | None, int | None]:
        """The payload, if it is wanted, and its length, of a record whose block of `left` bytes comes next."""
        http: dict[str, str] | None = None
        if head.get("content-type", "").startswith("application/http"):
            http, left = _fields(source, left)
        if head.get("warc-type") == "revisit":  # the head of the response only; its own length is that of the payload referred to
            _skip(source, left)
            return None, _length(http.get("content-length")) if http else None
        chunked = http is not None and http.get("transfer-encoding", "").lower() == "chunked"
        if not (self.payload or self.verify or chunked):
            _skip(source, left)
            return None, left
        data = source.read(left)
        if self.verify:
            digest, algorithm = head.get("warc-payload-digest", ""), "sha1:"
            # writers differ in whether a payload is digested before or after its transfer encoding is undone
            known = {base64.b32encode(hashlib.sha1(x).digest()).decode() for x in ((data, unchunked(data)) if chunked else (data,))}
            if len(data) < left:
                raise ValueError(f"{name}: the file ends inside the record")
            if digest.startswith(algorithm) and digest.removeprefix(algorithm).upper() not in known:
                raise ValueError(f"{name}: the payload doesn't have its digest")
        data = unchunked(data) if chunked else data
        return data, len(data)


def _skip(source, n: int) -> None:
    """Go n bytes further: by seeking in a plain file, by inflating in a compressed one."""
    if n:
        source.seek(n, io.SEEK_CUR)


class WarcDataSource(DataSource):
    """format("warc"): options path, payload and verify."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_warc(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a record for each row (page_id, url, html). Only payloads that occur more than once are looked up; payloads are shuffled if those
    are too many to be broadcast, by count."""
    spark = pages.sparkSession
    register(spark)
    bounded_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    shared = rows.filter(F.octet_length("payload") >= least).groupBy("sha1").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1")
    shared = materialise(shared.select("sha1", "first"), "payloads")
    few = shared.count() * 120 <= BROADCAST_BYTES
    refers = F.when((F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    out = rows.join(F.broadcast(shared) if few else shared, "sha1", "left").select("page_id", "target_uri", "payload", "sha1", refers.alias("refers_to"))
    out.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload)).option("verify", str(verify)).load(path)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payload=False, verify=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
