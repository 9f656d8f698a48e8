"""WARC archives: one gzip member for each record, read sequentially.

The writer makes a response record for one page of each group of equal payloads
and revisit records for the others. The reader decompresses member by member,
frames the block by Content-Length and verifies block and payload digests.
Archives are `.warc.gz` files, one for each task that writes; only those of tasks
that Spark committed are listed, so a task that is run again leaves a file that
nobody reads. A reading task streams a file in pieces of 64 KB and holds one
record. Archives of others are read the same way.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:tidemark:page:"
DATE = "2024-01-01T00:00:00Z"

#: Bytes of payloads that a reading task hands on at once.
CHUNK_BYTES = 1 << 20
LEVEL = 4


def digest(data: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: Any, url: str | None, payload: bytes, refers_to: Any = None) -> bytes:
    """One record as a gzip member: a revisit if `refers_to` is given. A revisit keeps the HTTP head, not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{RECORD_ID}{page_id}>"), ("WARC-Date", DATE)]
    if url is not None:  # control characters would break the framing
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{RECORD_ID}{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _members(source: Iterable[bytes]) -> Iterator[bytes]:
    """Decompressed gzip members of a stream of byte pieces."""
    z, out = zlib.decompressobj(31), []
    started = False
    for piece in source:
        while piece:
            started = True
            out.append(z.decompress(piece))
            piece = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out, started = zlib.decompressobj(31), [], False
            elif piece:
                raise ValueError("data after an unfinished member")
    if started:
        raise ValueError("the last member is cut off")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ":" in x)}


def parse(raw: bytes) -> dict[str, Any]:
    """A record's fields, HTTP head and payload; raises ValueError where framing or a digest is wrong."""
    if not raw.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    head, found, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    if not found or "content-length" not in fields:
        raise ValueError("a record without Content-Length")
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't fit the record")
    http, found, payload = b"", b"", block
    if fields.get("content-type", "application/http").startswith("application/http") and fields.get("warc-type") in ("response", "request", "revisit"):
        http, found, payload = block.partition(b"\r\n\r\n")
    http_fields = _fields(http) if found else {}
    checks = [("warc-block-digest", block)] + [("warc-payload-digest", payload)] * (fields.get("warc-type") == "response")
    for name, data in checks:
        algorithm, _, value = fields.get(name, "").partition(":")
        if algorithm == "sha1" and value != digest(data):
            raise ValueError(f"{name} doesn't fit the data")
    return {"fields": fields, "http": http_fields, "payload": payload}


def read_records(source: BinaryIO | Iterable[bytes]) -> Iterator[dict[str, Any]]:
    """Records of a file object or of byte pieces, one after another; memory holds one record."""
    pieces = iter(lambda: source.read(1 << 16), b"") if hasattr(source, "read") else source
    for raw in _members(pieces):
        yield parse(raw)


#: Tasks among which the pages of one payload are spread.
SALTS = 16


def plan_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`pages` (page_id, url, payload: binary) with refers_to: of equal payloads of at least `min_bytes`, the largest page_id answers and the others refer to it.

    Only payloads that occur more than once are looked up, in several copies, so
    that pages with one payload (all empty ones, say) don't meet in one task.
    """
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    keyed = pages.withColumns({"key": F.when(F.length("payload") >= min_bytes, F.sha2("payload", 256)), "salt": salt})
    first = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("page_id").alias("answer"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = first.select("key", "answer", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    joined = keyed.join(copies, ["key", "salt"], "left")
    other = F.col("answer").isNotNull() & ~F.col("answer").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("answer")).alias("refers_to"))


def located(uri: str) -> tuple[pa_fs.FileSystem, str]:
    """Arrow's file system and the path in it; local paths and file, hdfs, s3 (s3a), gs and abfs addresses."""
    if "://" not in uri and not uri.startswith("file:"):
        return pa_fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pa_fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa_fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """path, records: each task streams its rows (page_id, url, payload, refers_to) to an archive below `folder`. Write the result down before it is read: computed again, it names new files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, n = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for i in range(b.num_rows):
                if out is None:  # a task without rows has no archive
                    store, name = located(path)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(name, compression=None)
                page_id, url, payload, ref = (b.column(k)[i].as_py() for k in range(4))
                out.write(record(page_id, url, payload or b"", ref))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return planned.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long")


def read_archives(archives: DataFrame, tasks: int) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of every record of the files in `path` (a revisit has no payload).

    Files are dealt to `tasks` tasks; a gzip file can't be read from its middle, so one
    task reads a whole file, record by record. Records of other types (warcinfo, say) have
    no page_id and a payload as it stands; ids that aren't ours are null. A digest
    that the record doesn't state is that of its payload.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def number(field: str | None) -> int | None:
        text = (field or "").strip("<>").removeprefix(RECORD_ID)
        return int(text) if re.fullmatch(r"-?\d+", text) else None

    def records(path: str) -> Iterator[tuple]:
        store, name = located(path)
        with store.open_input_stream(name, compression=None, buffer_size=0) as f:
            for r in read_records(f):
                fields, kind = r["fields"], r["fields"].get("warc-type")
                n = int(r["http"].get("content-length", len(r["payload"]))) if kind == "revisit" else len(r["payload"])
                stated = fields.get("warc-payload-digest", "")
                sha = stated.removeprefix("sha1:") if stated.startswith("sha1:") else digest(r["payload"])
                yield number(fields.get("warc-record-id")), fields.get("warc-target-uri"), n, sha, kind, number(fields.get("warc-refers-to")), None if kind == "revisit" else r["payload"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                for row in records(path):
                    rows.append(row)
                    size += len(row[-1] or b"") + 200
                    if size >= CHUNK_BYTES:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    return archives.select("path").repartition(tasks).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Records of all archives that a path or pattern names, those of others too; columns as of `read_archives`. Only names are listed: contents are streamed by the tasks."""
    names = spark.read.format("binaryFile").load(pattern).select("path")
    return read_archives(names, max(1, names.count()))


def round_trip(spark: SparkSession, pages: DataFrame, html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for each row of `pages` (page_id, url, html) and read the archives back.

    page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is
    an empty payload, a null url leaves the target out. Of rows that repeat a
    page_id with the same payload, all with the largest page_id are responses. Rows
    without page_id refer to the group's largest page_id; if there is none, they
    are responses. An empty table gives no rows.
    """
    ws = Workspace(spark)
    src = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    archives = ws.write(write_archives(plan_revisits(src, min_bytes), f"{ws.root}/warc"), "archives")
    return ws.close(read_archives(archives, max(1, archives.count())).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
