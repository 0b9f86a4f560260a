"""WARC archives (operator 5): monolithic gzip in, one gzip member a record out, with an offset index.

`write_archives` writes pages as WARC records into whole-file gzip streams, as crawlers leave them.
`normalise` inflates each such stream once, front to back, and writes every record again as a gzip
member of its own; a sidecar file beside the archive has offset and length of each member, so any
record can be read by one seek. `read_archives` reads records through that index.

A payload is the html in UTF-8. Of records with equal payloads of at least 100 bytes, the one with
the smallest page_id is the response and the others are revisits that refer to it.

Files lie in the shared folder. Each is written under a temporary name and renamed when complete;
the list of files is itself a table written by Spark, so files of lost or repeated tasks are
never read.

A record's id follows from its page_id and payload; rows that are equal in both are copies of one record and
share its id; that of a record without a page_id follows from its payload and its place (task and row), so a repeated task gives it again.

Edge cases: null html = empty payload; a null url is an empty target; rows with equal page_id and
equal payload are all responses when that id is the smallest; null page_ids come last (a group with
no other id has responses only); an empty table gives no records; a broken or cut archive raises an
error that names it; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written
from .files import NewFile, make_folder, open_random, open_stream

LEAST_BYTES = 100
#: Bytes before compression after which a task opens its next archive.
ARCHIVE_BYTES = 64 << 20
_PIECE = 1 << 18

MANIFEST = "archive string, records long"
NORMALISED = "archive string, sidecar string, records long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_roles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, first: the page that has the payload, null where it is only here."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    shared = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = written(shared.where("n > 1").select("digest", "first"), "warc-shared")
    return rows.join(shared, "digest", "left")  # by the sizes Spark broadcasts, or shuffles and splits skewed sides


def _record_id(page_id: int | None, digest: str, place: str | None = None) -> str:
    own = f"page:{page_id}:{digest}" if page_id is not None else place and f"place:{place}:{digest}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, own) if own else uuid.uuid4()}>"


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, first: int | None, place: str | None = None) -> bytes:
    """One WARC record; a revisit (first is another page) has the HTTP head only. `place` tells records without a page_id apart (without it their ids are random)."""
    revisit = first is not None and first != page_id
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest, place)}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(first, digest)}", f"X-Refers-To-Page: {first}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes whole-file gzip archives and returns their list."""

    def run(batches: Iterator[pa.RecordBatch]):
        out = pack = None
        part, row_number, records, size = TaskContext.get().partitionId(), 0, 0, 0
        made: list[tuple[str, int]] = []
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in ("page_id", "url", "html", "digest", "first")}
                if out is None:
                    out, pack, records, size = NewFile(folder, ".mono.warc.gz"), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data = record_bytes(row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["digest"], row["first"], f"{part}:{row_number}")
                row_number += 1
                out.write(pack.compress(data))
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    out.write(pack.flush())
                    made.append((out.done(), records))
                    out = None
        if out is not None:
            out.write(pack.flush())
            made.append((out.done(), records))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["archive", "records"])

    return written(with_roles(pages).select("page_id", "url", "html", "digest", "first").mapInArrow(run, MANIFEST), "warc-list")


def inflated(uri: str) -> Iterator[bytes]:
    """Pieces of the inflated stream, of any number of gzip members in a row."""
    with open_stream(uri) as source:
        unpack, fresh = zlib.decompressobj(31), True
        while data := source.read(_PIECE):
            while data:
                try:
                    piece = unpack.decompress(data, 1 << 20)
                except zlib.error as why:
                    raise ValueError(f"{uri} is not a gzip stream: {why}") from why
                fresh = False
                if piece:
                    yield piece
                data = unpack.unconsumed_tail
                if unpack.eof:
                    data, unpack, fresh = unpack.unused_data, zlib.decompressobj(31), True
        if not fresh:
            raise ValueError(f"{uri} ends inside a gzip member")


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records_of(uri: str) -> Iterator[bytes]:
    """Whole records of an archive; memory holds one record and a piece of the stream."""
    pieces, held = inflated(uri), bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        seen = 0
        while (cut := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError(f"{uri} ends inside a record")
        if not held.startswith(b"WARC/"):
            raise ValueError(f"{uri} holds something that is no WARC record")
        end = cut + 4 + int(headers(bytes(held[:cut]))["content-length"]) + 4
        if not fill(end):
            raise ValueError(f"{uri} ends inside a record")
        yield bytes(held[:end])
        del held[:end]


def gzip_member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _spread(files: DataFrame) -> DataFrame:
    """One file a task, or a few."""
    n = files.count()
    return files.repartition(max(1, min(n, 4 * files.sparkSession.sparkContext.defaultParallelism + n // 8)))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive again with a member for each record and a sidecar index, and returns the list."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                out, side, n = NewFile(folder, ".warc.gz"), NewFile(folder, ".index.jsonl"), 0
                for record in records_of(uri):
                    head = headers(record[: record.index(b"\r\n\r\n")])
                    member, at = gzip_member(record), out.size
                    out.write(member)
                    side.write(json.dumps({"offset": at, "length": len(member), "type": head["warc-type"], "id": head["warc-record-id"]}).encode() + b"\n")
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array([out.done()]), pa.array([side.done()]), pa.array([n], pa.int64())], ["archive", "sidecar", "records"])

    return written(_spread(archives).mapInArrow(run, NORMALISED), "warc-members")


def read_record(archive, offset: int, length: int) -> bytes:
    """The record whose member lies at `offset`: one seek, no other member is read."""
    archive.seek(offset)
    return zlib.decompress(archive.read(length), 31)


def parsed(record: bytes) -> tuple:
    """A row of RECORD; the digest and size of a response are those of the payload that is there."""
    cut = record.index(b"\r\n\r\n")
    head, block = headers(record[:cut]), record[cut + 4 : -4]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(headers(http)["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
    if head["warc-type"] == "response":
        if (size, digest) != (len(payload), hashlib.sha256(payload).hexdigest()):
            raise ValueError(f"record {head['warc-record-id']} differs from its digest")
    own, other = head["x-page-id"], head.get("x-refers-to-page", "")
    return int(own) if own else None, head["warc-target-uri"], size, digest, head["warc-type"], int(other) if other else None


def read_archives(normalised: DataFrame) -> DataFrame:
    """Every record of the archives, each read through the sidecar index."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for uri, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist(), strict=True):
                with open_stream(sidecar) as side, open_random(uri) as archive:
                    entries = [json.loads(x) for x in side.read().splitlines()]
                    for at in range(0, len(entries), 1000):
                        rows = [parsed(read_record(archive, e["offset"], e["length"])) for e in entries[at : at + 1000]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return _spread(normalised).mapInArrow(run, RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages to monolithic archives, those to member-wise archives; returns the list of the latter."""
    folder = make_folder(scratch(spark, "warc"))
    return normalise(write_archives(pages, folder, archive_bytes), folder)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
