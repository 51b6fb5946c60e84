"""WARC archives: a writer with payload de-duplication and a splittable reader.

Every record is a gzip member of its own. Writers run as tasks, each into files of its own in
a shared folder; a manifest table, committed by Spark, names the files that count, so what a
lost task left behind is never read. Readers get byte ranges: a task looks for the gzip magic,
takes a candidate for a member only if its header decodes to the head of a WARC record, the
whole member decodes with a right checksum and the end of the file or another member follows,
and then reads on from member to member. It owns the records that start inside its range.

Defined cases: a null payload is empty; a null url has no target line; control characters in a
url are percent-encoded. Of equal payloads the smallest record id is the response; repeated
rows of that id are responses too. Rows with a null id are written without an id line.
Empty input: no archive, no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odqa_spark.llm.frames import materialize, scratch_path

MAGIC = b"\x1f\x8b\x08"
HEAD = b"WARC/1."
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 1 << 30
SPLIT_BYTES = 16 << 20
_READ = 1 << 18
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_RECORD_ID = "<urn:x-record:%d>"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path; local paths may have no scheme."""
    if path.startswith("s3a://"):
        path = "s3://" + path[6:]
    return pafs.FileSystem.from_uri("file://" + path[5:] if re.match(r"file:/[^/]", path) else path)


def _record(record_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit")]
    if record_id is not None:
        lines.append("WARC-Record-ID: " + _RECORD_ID % record_id)
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: "%%%02X" % ord(m[0]), url))
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines.append("WARC-Refers-To: " + _RECORD_ID % refers_to)
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds refers_to: the smallest id with an equal payload, null for that one and for payloads under ``min_bytes``.

    Needs columns record_id, url, payload. Only digests are grouped, with partial sums per task;
    only rows that revisit another are joined back.
    """
    named = pages.select("record_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("bytes"))
    groups = named.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("record_id").alias("first"), F.count("*").alias("n"))
    revisited = groups.where("n > 1 and first is not null")
    joined = pages.withColumn("digest", F.sha2("payload", 256)).join(revisited.select("digest", "first"), "digest", "left")
    other = F.col("first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first"))
    return joined.select("record_id", "url", "payload", F.when(other, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row below ``folder``; returns the committed manifest (path, bytes, records)."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("record_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, count = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for rid, target, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    part = TaskContext.get().partitionId()
                    name = f"{base}/part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, count = fs.open_output_stream(name, compression=None), 0, 0
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(_record(rid, target, payload, _base32_sha1(payload), refers)) + packer.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        if done:
            paths = [folder.rstrip("/") + "/" + p.rsplit("/", 1)[1] for p, _, _ in done]
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths), pa.array([s for _, s, _ in done], pa.int64()), pa.array([n for _, _, n in done], pa.int64())],
                ["path", "bytes", "records"],
            )

    written = with_revisits(rows, min_bytes).mapInArrow(run, "path string, bytes bigint, records bigint")
    return materialize(written, "warc-manifest")


def list_archives(spark: SparkSession, glob: str) -> DataFrame:
    """(path, bytes) of archives that a path pattern names, listed by Spark without reading them."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("bytes"))


class _Source:
    """A file with a moving window of its bytes."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size

    def at(self, offset: int, n: int) -> bytes:
        self.handle.seek(offset)
        return self.handle.read(min(n, self.size - offset))


def _member(src: _Source, offset: int, checked: bool) -> tuple[bytes, int] | None:
    """The decoded member at ``offset`` and where it ends, or None if none of a WARC record is there."""
    unzip = zlib.decompressobj(31)
    out, size, at, step = [], 0, offset, 4096 if checked else _READ
    try:
        while not unzip.eof:
            raw = src.at(at, step)
            if not raw:
                return None
            piece = unzip.decompress(raw)
            at += len(raw)
            out.append(piece)
            size += len(piece)
            if checked and size >= len(HEAD):
                if not b"".join(out).startswith(HEAD):
                    return None
                checked, step = False, _READ
    except zlib.error:
        return None
    data = b"".join(out)
    return (data, at - len(unzip.unused_data)) if data.startswith(HEAD) else None


def _first_member(src: _Source, start: int, end: int) -> int | None:
    """The first offset in [start, end) at which a record's member begins."""
    at = start
    while at < end:
        raw = src.at(at, _READ + len(MAGIC) - 1)
        hit = raw.find(MAGIC)
        while hit >= 0 and at + hit < end:
            found = _member(src, at + hit, True)
            if found and (found[1] >= src.size or src.at(found[1], len(MAGIC)) == MAGIC):
                return at + hit
            hit = raw.find(MAGIC, hit + 1)
        at += _READ
    return None


def _parsed(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    number = lambda name: (m := re.search(r"x-record:(-?\d+)>", fields.get(name, ""))) and int(m[1])
    revisit = fields.get("warc-type") == "revisit"
    claimed = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    digest = claimed if revisit else _base32_sha1(payload)
    return (
        number("warc-record-id"),
        fields.get("warc-type"),
        fields.get("warc-target-uri"),
        number("warc-refers-to"),
        None if revisit else payload,
        int(length[1]) if revisit and length else len(payload),
        digest,
        digest == claimed,
    )


_READ_SCHEMA = (
    "record_id bigint, record_type string, url string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string, digest_ok boolean"
)


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives (path, bytes), each read by the task in whose byte range it starts.

    A revisit has no payload of its own; its payload_bytes and digest are those of the payload it refers to.
    """
    spark = archives.sparkSession
    ranges = archives.select("path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {int(split_bytes)}L)")).alias("start"))
    names = [f.split()[0] for f in _READ_SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as handle:
                    src = _Source(handle, size)
                    end = min(size, start + split_bytes)
                    at = _first_member(src, start, end)
                    rows, held = [], 0
                    while at is not None and at < end:
                        found = _member(src, at, False)
                        if found is None:  # other bytes between members
                            at = _first_member(src, at + 1, end)
                            continue
                        rows.append(_parsed(found[0]))
                        at, held = found[1], held + len(found[0])
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    tasks = max(1, spark.sparkContext.defaultParallelism * 2)
    return ranges.repartition(tasks).mapInArrow(run, _READ_SCHEMA)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the cluster's shared folder."""
    return scratch_path(spark, "warc")
