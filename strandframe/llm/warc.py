"""Operator 3: WARC archives, and the normaliser of archives that were compressed as one gzip stream.

Crawlers and mirrors hand out archives of which the whole file is one gzip member; nothing in them can be read without
inflating all that stands before. The normaliser inflates such a stream once, writes every record as a gzip member of its
own, and puts a tab-separated index of offsets beside the archive, so that later readers can seek and split.

Files are written under the shared folder through pyarrow's file systems. A task names its files by a fresh id and returns
what it wrote; the rows of finished tasks are kept in a table, so files of failed attempts are never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .tokens import small

#: Payloads shorter than this are always stored; an archive is closed once it holds so many bytes of records.
SMALL_PAYLOAD = 100
ARCHIVE_BYTES = 32 << 20
LEVEL = 1
#: A fixed date keeps reruns byte for byte alike.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 18


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" not in path:
        path = re.sub(r"^file:", "", path)
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(path)


def record(kind: str, page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header alone, whose Content-Length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class Parser:
    """Splits inflated bytes, fed in pieces, into records (headers, block, raw bytes)."""

    def __init__(self):
        self.held = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        self.held += data
        at = 0
        while (end := self.held.find(b"\r\n\r\n", at)) >= 0:
            lines = bytes(self.held[at:end]).decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            body = end + 4
            stop = body + int(head["content-length"])
            if len(self.held) < stop + 4:
                break
            yield head, bytes(self.held[body:stop]), bytes(self.held[at : stop + 4])
            at = stop + 4
        del self.held[:at]


def inflated(source) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in pieces of bounded size."""
    inflate = zlib.decompressobj(31)
    while data := source.read(BLOCK):
        while data:
            piece = inflate.decompress(data, 4 * BLOCK)
            if piece:
                yield piece
            if inflate.eof:
                data = inflate.unused_data
                inflate = zlib.decompressobj(31)
            else:
                data = inflate.unconsumed_tail
    if tail := inflate.flush():
        yield tail


def write_monolithic(pages: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows (page, url, payload, digest, kind, refers_to) as archives that are one gzip member each; returns (path, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)
        fs.create_dir(base, recursive=True)
        out, path, records, held, gz = None, "", 0, 0, None

        def close() -> pa.RecordBatch:
            out.write(gz.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])

        for b in small(batches, 64):
            for row in b.to_pylist():
                if out is None:
                    path, records, held = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, gz = fs.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = record(row["kind"], row["page"], row["url"], row["payload"], row["digest"], row["refers_to"])
                out.write(gz.compress(raw))
                records, held = records + 1, held + len(raw)
                if held >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return pages.select("page", "url", "payload", "digest", "kind", "refers_to").mapInArrow(write, "path string, records long")


def normalise(archives: DataFrame, root: str) -> DataFrame:
    """Rewrites each archive (path) with one member per record and a sidecar index; returns the index rows (path, offset, length, page, kind)."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)
        fs.create_dir(base, recursive=True)
        for b in batches:
            for source in b.column(0).to_pylist():
                path, parser, at, rows = f"{base}/{uuid.uuid4().hex}.warc.gz", Parser(), 0, []
                with fs.open_input_stream(source, compression=None) as raw, fs.open_output_stream(path, compression=None) as out:
                    for piece in inflated(raw):
                        for head, _, whole in parser.feed(piece):
                            gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                            member = gz.compress(whole) + gz.flush()
                            out.write(member)
                            rows.append((path, at, len(member), head["warc-record-id"], head["warc-type"], head.get("warc-target-uri", "")))
                            at += len(member)
                if parser.held:
                    raise ValueError(f"{source} ends inside a record")
                with fs.open_output_stream(path + ".idx", compression=None) as idx:
                    for r in rows:
                        idx.write(("\t".join(map(str, r[1:])) + "\n").encode())
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], ["path", "offset", "length", "record_id", "kind"])

    return archives.select("path").mapInArrow(rewrite, "path string, offset long, length long, record_id string, kind string")


def read_members(index: DataFrame) -> DataFrame:
    """Seeks to each indexed member and parses it: (page, url, payload_bytes, payload_digest, record_type, refers_to, payload).

    A response's digest is computed from the bytes read and must equal the one it states; a revisit states its payload's.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            out, path, file = [], None, None
            for r in b.to_pylist():
                if r["path"] != path:
                    path = r["path"]
                    file = store(path)[0].open_input_file(path)
                file.seek(r["offset"])
                raw = zlib.decompress(file.read(r["length"]), 31)
                ((head, block, _),) = Parser().feed(raw)
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                digest = head["warc-payload-digest"].partition(":")[2]
                if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{path}@{r['offset']}: the payload does not fit its record")
                name = lambda x: x[len("<urn:page:") : -1]
                out.append((name(head["warc-record-id"]), head["warc-target-uri"], size, digest, head["warc-type"], name(head["warc-refers-to"]) if "warc-refers-to" in head else None, payload))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return index.mapInArrow(read, "page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def archive(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Marks repeats, writes the pages as whole-stream archives, normalises these and returns their index.

    Of pages with equal payloads of at least SMALL_PAYLOAD bytes the one with the smallest key is the response and the others
    revisit it; null keys come last, and rows that repeat the smallest key are all responses. A null html is an empty payload,
    a null url becomes urn:none. A key is written as text, a null one as null, which a key of that text could not be told from.
    An empty table gives an empty index. Pages may be of any length. Extra columns are not looked at.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    own = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256)).withColumn("large", F.octet_length("payload") >= SMALL_PAYLOAD)
    # Written before it is joined, so that both sides of the join are plain exchanges, which Spark splits where one page is very common.
    firsts = own.filter("large").groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("of"), "first")
    firsts = scratch.put(firsts)
    marked = own.join(firsts, (F.col("digest") == F.col("of")) & F.col("large"), "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("k"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    rows = marked.select(text("k").alias("page"), "url", "payload", "digest", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"), F.when(again, text("first")).alias("refers_to"))
    whole = scratch.put(write_monolithic(rows, scratch.path()))
    # A row here is an archive, and a row of the index a read: dealt by number, since by their own few bytes all would go to one task.
    n = max(1, whole.count())
    index = scratch.put(normalise(whole.repartition(n), scratch.path()))
    return index.repartition(n, "path").sortWithinPartitions("path", "offset")


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_members(archive(table(spark, sf_dir, "pages")))
    return read.select(
        F.nullif("page", F.lit("null")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.nullif("refers_to", F.lit("null")).cast("long").alias("refers_to"), "url",
    )


OP3_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d AS fd, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to, url
FROM p LEFT JOIN f ON d = fd AND n >= 100
"""
