"""WARC archives of pages: a writer with revisit records, and a reader that splits files at any byte.

Writing.  Pages with equal payloads are told by sha256 and length; the smallest id of each is found with partial aggregation
and joined back with salted keys, so a payload that a third of all pages share is no hot key.  Each task writes its pages as
records, each a gzip member of its own, to new files of the shared folder and returns a manifest row for each file; only
files of a finished task are in the stored manifest, so what a lost task has left behind is never read.

Reading.  Tasks are byte ranges of the files.  Each looks for gzip's magic bytes in its range, takes them for a member only
if the member's head inflates to WARC headers and the whole of it, which may go on beyond the range, passes gzip's checksum
and has the declared length; then the search goes on behind it.  A record belongs to the range in which it starts, so each is
read exactly once whatever the cuts.  A member that begins inside another one (a stored archive as a payload) is met only
where a range starts within the outer record; such ones are dropped by the spans of records that cross a range's end.

Null payloads are empty.  Of pages with equal payloads of at least ``least`` bytes the one with the smallest id is the
response, all rows with that id included; a page without an id revisits it too, and is a response where no page with an
id has its payload.  Ids must be integers; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: A task's file is closed and the next begun after so many compressed bytes.
FILE_BYTES = 1 << 30
#: Bytes of a file that one task of the reader looks through.
SPLIT_BYTES = 32 << 20
SALTS = 64
# fixed values: the format
MAGIC, VERSION, PROFILE = b"\x1f\x8b\x08", "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, bytes long, records long"
RECORD = "path string, offset long, size long, record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, read_digest string, payload binary"
_HEAD_MOST = 1 << 20
_UNSAFE = re.compile(r"[\x00-\x20\x7f%]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ----------------------------------------------------------------------------------------- writing
def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, size: int, compression: int = 6) -> bytes:
    """One record as a gzip member; a revisit has the HTTP headers of the payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_UNSAFE.sub(lambda m: quote(m[0]), url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(compression, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _write_part(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        out, path, size, n, done = None, "", 0, 0, []
        try:
            for batch in batches:
                for page_id, url, html, refers_to, sha1, length in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "sha1", "payload_bytes"))):
                    if out is None:  # a name of its own for each attempt of a task
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        out, path, size, n = files.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0, 0
                    member = record_bytes(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, base64.b32encode(sha1).decode(), length)
                    out.write(member)
                    size, n = size + len(member), n + 1
                    if size >= file_bytes:
                        out.close()
                        out = None
                        done.append((path, size, n))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((path, size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "bytes", "records"])

    return write


def with_roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """Rows (page_id, url, html, refers_to, sha1, payload_bytes); html is null for revisits.

    Who revisits whom is found on narrow rows, stored once; payloads are shuffled only to meet that decision.
    """
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"),
        F.unhex(F.sha2(html, 256)).alias("key"),
    )
    narrow = C.stored(rows.where(F.col("payload_bytes") >= least).select("page_id", "key"), "page-keys")
    firsts = narrow.groupBy("key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").select("key", "first_id")
    roles = C.spread_join(narrow.distinct(), firsts, "key", "page_id", SALTS).where("page_id IS NULL OR page_id > first_id")
    roles = roles.select(F.col("page_id").alias("__id"), F.col("key").alias("__key"), "first_id")
    out = rows.join(roles, F.col("key").eqNullSafe(F.col("__key")) & F.col("page_id").eqNullSafe(F.col("__id")), "left")
    sha1 = F.unhex(F.sha1(F.encode("html", "UTF-8")))
    return out.select("page_id", "url", F.when(F.col("first_id").isNull(), F.col("html")).alias("html"), F.col("first_id").alias("refers_to"), sha1.alias("sha1"), "payload_bytes")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark gives it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_warc(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Writes all pages to ``folder`` (by default a new one in the shared folder); returns the stored manifest (path, bytes, records)."""
    folder = qualified(pages.sparkSession, folder or f"{C.scratch_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    files, base = pafs.FileSystem.from_uri(folder)
    files.create_dir(base)
    rows = with_roles(pages, id_col, url_col, payload_col, least)
    return C.stored(rows.mapInArrow(_write_part(folder, file_bytes), MANIFEST), "warc-manifest")


# ----------------------------------------------------------------------------------------- reading
class _Window:
    """Bytes of a file from a position on, read as they are asked for."""

    def __init__(self, file, size: int, begin: int, end: int):
        self.file, self.size, self.begin, self.end = file, size, begin, end
        file.seek(begin)
        self.data = file.read(min(end, size) - begin)

    def piece(self, at: int, most: int) -> bytes:
        if at < self.begin + len(self.data):
            return self.data[at - self.begin : at - self.begin + most]
        self.file.seek(at)
        return self.file.read(min(most, self.size - at))


def inflate_member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The record in the member at a position and the position behind it; None if there is no whole WARC member."""
    unpack, got, pos, known = zlib.decompressobj(31), [], at, False
    try:
        while not unpack.eof:
            piece = window.piece(pos, 1 << 14)
            if not piece:
                return None
            pos += len(piece)
            got.append(unpack.decompress(piece))
            if not known:
                start = got[0] if len(got) == 1 else b"".join(got)
                if not b"WARC/1.".startswith(start[:7]):
                    return None
                known = len(start) >= 7
    except zlib.error:
        return None
    return b"".join(got), pos - len(unpack.unused_data)


def parse_record(raw: bytes) -> dict | None:
    """Fields of a record; None unless its headers are whole and its block has the declared length."""
    cut = raw.find(b"\r\n\r\n", 0, _HEAD_MOST)
    if not raw.startswith(b"WARC/1.") or cut < 0:
        return None
    fields = {}
    for line in raw[:cut].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        return None
    n = int(fields["content-length"])
    block = raw[cut + 4 : cut + 4 + n]
    if len(block) != n or raw[cut + 4 + n :] != b"\r\n\r\n":
        return None
    return fields | {"block": block}


def _page_of(urn: str | None) -> int | None:
    found = re.match(r"<urn:page:(-?\d+):", urn or "")
    return int(found[1]) if found else None


def records_from(path: str, size: int, begin: int, end: int, with_payload: bool) -> Iterator[tuple]:
    """The records that start in [begin, end) of a file."""
    files, base = pafs.FileSystem.from_uri(path)
    with files.open_input_file(base) as file:
        window = _Window(file, size, begin, end + len(MAGIC) - 1)
        at = window.data.find(MAGIC)
        while 0 <= at < end - begin:
            member = inflate_member(window, begin + at)
            record = parse_record(member[0]) if member else None
            if record is None:
                at = window.data.find(MAGIC, at + 1)
                continue
            head, _, body = record["block"].partition(b"\r\n\r\n")
            kind, digest = record.get("warc-type"), record.get("warc-payload-digest", "").removeprefix("sha1:") or None
            length, read = len(body), base32_sha1(body)
            if kind == "revisit":
                told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                length, read, body = int(told[1]) if told else None, None, None
            yield (
                path, begin + at, member[1] - begin - at, kind, _page_of(record.get("warc-record-id")), unquote(record.get("warc-target-uri", "")), _page_of(record.get("warc-refers-to")),
                digest, length, read, body if with_payload else None,
            )
            at = window.data.find(MAGIC, member[1] - begin)


def _scan(with_payload: bool, most: int = 8 << 20):
    schema = pa.schema([
        ("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("read_digest", pa.string()), ("payload", pa.binary()),
    ])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def scan(batches):
        rows, held = [], 0
        for ranges in batches:
            for r in ranges.to_pylist():
                for record in records_from(r["path"], r["bytes"], r["begin"], r["end"], with_payload):
                    rows.append(record)
                    held += 200 + len(record[-1] or b"")
                    if held >= most:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return scan


def read_warc(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """All records of the files (path, bytes): where they lie, their headers, and the payload, its length and its digest.

    A revisit has the digest and length that its headers declare and no payload; ``resolved`` gives it those of the record
    it refers to.  Bytes between members that are no record are skipped.
    """
    begins = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("begin"))
    ranges = begins.withColumn("end", F.least(F.col("begin") + split_bytes, F.col("bytes")))
    splits = int(ranges.count())
    dealt = ranges.repartition(max(1, 2 * splits), "path", "begin")  # room, so that few tasks get several ranges
    found = C.stored(dealt.mapInArrow(_scan(with_payload), RECORD), "warc-records")
    # at most one record of a range crosses its end: what seems to begin inside of one is part of its payload
    first, last = (F.col("offset") / split_bytes).cast("long"), ((F.col("offset") + F.col("size") - 1) / split_bytes).cast("long")
    crossing = found.where(last > first).select("path", F.explode(F.sequence(first, last)).alias("part"), F.col("offset").alias("from"), (F.col("offset") + F.col("size")).alias("to"))
    inside = found.select("path", "offset", first.alias("part")).join(crossing, ["path", "part"]).where("offset > `from` AND offset < `to`").select("path", "offset").distinct()
    return found.join(inside, ["path", "offset"], "left_anti").select(*found.columns)


def resolved(records: DataFrame) -> DataFrame:
    """Columns page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit has what was read from its response.

    Revisits are dealt by their own id, so a response to which a third of all records refer is no hot key.  One whose
    response was not read, or has another digest than it declares, has nulls.
    """
    response = records.where("record_type = 'response'").select("page_id", "payload_bytes", F.col("read_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    target = response.where("page_id IS NOT NULL").groupBy(F.struct(F.col("page_id"), F.col("payload_digest")).alias("target")).agg(F.max("payload_bytes").alias("read_bytes"))
    revisit = records.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.struct(F.col("refers_to").alias("page_id"), "payload_digest").alias("target"))
    salted = revisit.withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    slots = salted.select("target", "__salt").distinct().join(target, "target")
    told = salted.join(slots, ["target", "__salt"], "left")
    told = told.select("page_id", F.col("read_bytes").alias("payload_bytes"), F.when(F.col("read_bytes").isNotNull(), F.col("target.payload_digest")).alias("payload_digest"), "record_type", "refers_to")
    return response.unionByName(told)
