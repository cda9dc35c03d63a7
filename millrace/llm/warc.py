"""WARC archives: written as one gzip stream a file, then normalised to a member per record with an offset index.

The normaliser inflates each whole-file stream once, from front to back, holds one record at a time, and writes it as
a gzip member of its own; a sidecar index names the place of every member, so that a record can be read without those
before it. Files are written under a name of their own and moved when whole, so that a task that runs again does no
harm. Of pages with equal payloads of at least `least_bytes`, the one of the largest id is stored (repeated rows of
that id all are), the others are revisits that refer to it and hold headers only.

Null html is an empty payload; a null url or id leaves its header out, and a null id is smaller than every other. Empty
tables give no files and no rows. A page is held whole while its record is made. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, open_folder, query, rows_of, table

DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, payload_digest: str) -> bytes:
    """One record; a revisit if it refers to a page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {payload_digest}')}>"]
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.translate({13: "%0D", 10: "%0A"}))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if line)


def inflated(file, size: int = 1 << 20) -> Iterator[bytes]:
    """The contents of a gzip stream, which may have one member or many."""
    unzip = zlib.decompressobj(31)
    while data := file.read(size):
        while data:
            yield unzip.decompress(data)
            data = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)


def records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) one after the other."""
    have, at = bytearray(), 0
    parts = inflated(file)
    while True:
        while (end := have.find(b"\r\n\r\n", at)) < 0:
            if (more := next(parts, None)) is None:
                return
            have = have[at:] + more
            at = 0
        head = headers(bytes(have[at:end]))
        size = end - at + 8 + int(head["Content-Length"])
        while len(have) - at < size:
            have = have[at:] + next(parts)
            at = 0
        yield head, bytes(have[at : at + size])
        at += size


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_FILES = pa.schema([("file", pa.string()), ("n_records", pa.int64())])


def _write(folder: str):
    """Each task's records as one gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        name, own, out, n = f"pages-{TaskContext.get().partitionId():06d}.warc.gz", f".{uuid.uuid4().hex}", None, 0
        for batch in rows_of(batches):
            if out is None:
                files.create_dir(path, recursive=True)
                out, pack = files.open_output_stream(f"{path}/{own}"), zlib.compressobj(1, zlib.DEFLATED, 31)
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for page_id, url, html, refers_to, payload_digest in zip(*columns, strict=True):
                out.write(pack.compress(record(page_id, url, html or b"", refers_to, payload_digest)))
                n += 1
        if out is not None:
            out.write(pack.flush())
            out.close()
            files.move(f"{path}/{own}", f"{path}/{name}")
            yield _batch([(f"{folder}/{name}", n)], _FILES)

    return run


_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])


def _normalise(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                files, path = open_folder(source)
                _, target = open_folder(folder)
                files.create_dir(target, recursive=True)
                name, own = source.rsplit("/", 1)[1], f".{uuid.uuid4().hex}"
                offset, rows = 0, []
                with files.open_input_stream(path, compression=None) as file, files.open_output_stream(f"{target}/{own}", compression=None) as out:
                    for head, whole in records(file):
                        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = pack.compress(whole) + pack.flush()
                        out.write(member)
                        rows.append((f"{folder}/{name}", offset, len(member), head["WARC-Record-ID"], head["WARC-Type"]))
                        offset += len(member)
                        if len(rows) == 4096:
                            yield _batch(rows, _INDEX)
                            rows = []
                files.move(f"{target}/{own}", f"{target}/{name}")
                if rows:
                    yield _batch(rows, _INDEX)

    return run


def write_archives(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Whole-file gzip archives; one row for each: file, n_records."""
    payload = F.coalesce(pages[f"`{html_col}`"].cast("binary"), F.lit(b""))
    df = pages.select(pages[f"`{id_col}`"].cast("long").alias("id"), pages[f"`{url_col}`"].cast("string").alias("url"), payload.alias("html"))
    df = df.withColumn("digest", F.sha1("html"))
    stored = df.filter(F.length("html") >= least_bytes).groupBy("digest").agg(F.max("id").alias("stored"))
    df = df.join(stored, "digest", "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("stored")), F.col("stored"))
    rows = df.select("id", "url", "html", refers.alias("refers_to"), base32(F.col("digest")).alias("digest"))
    return scratch.write(rows.mapInArrow(_write(scratch.path("streams")), "file string, n_records long"), "files")


def base32(hexes):
    """RFC 4648 base 32, of 160 bits given in hex: 32 groups of five bits."""
    out = []
    for half in range(4):  # 40 bits are eight letters, and fit a long
        bits = F.conv(F.substring(hexes, 10 * half + 1, 10), 16, 10).cast("long")
        for k in range(8):
            at = F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int")
            out.append(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), at + 1, F.lit(1)))
    return F.concat(*out)


def normalise(archives: DataFrame, scratch: Scratch, level: int = 6) -> DataFrame:
    """Archives with a member per record beside their index: file, offset, length, record_id, record_type."""
    # a task for each file: a number that is given is not coalesced, however small the rows are
    files = archives.select("file").repartitionByRange(max(1, archives.count()), "file")
    return scratch.write(files.mapInArrow(_normalise(scratch.path("records"), level), "file string, offset long, length long, record_id string, record_type string"), "index")


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name = file = None
    for batch in rows_of(batches):
        rows, size = [], 0
        for source, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if source != name:
                files, path = open_folder(source)
                file, name = files.open_input_file(path), source
            file.seek(offset)
            whole = zlib.decompress(file.read(length), 31)
            end = whole.index(b"\r\n\r\n")
            head = headers(whole[:end])
            block = whole[end + 4 : end + 4 + int(head["Content-Length"])]
            payload = block[block.index(b"\r\n\r\n") + 4 :] if head["WARC-Type"] == "response" else None
            n, found = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
            if payload is not None and (len(payload) != n or digest(payload) != found):
                raise ValueError(f"{source} at {offset}: the payload is not what its headers say")
            number = lambda key, head=head: int(head[key]) if key in head else None
            rows.append((number("X-Page-ID"), n, found, head["WARC-Type"], number("X-Refers-To-Page-ID"), head.get("WARC-Target-URI"), payload))
            size += len(payload or b"")
            if size > 4 << 20:
                yield _batch(rows, _READ)
                rows, size = [], 0
        if rows:
            yield _batch(rows, _READ)


def read_archives(index: DataFrame) -> DataFrame:
    """Every record by its place in the index: page_id, payload_bytes, payload_digest, record_type, refers_to, url and
    payload (null for revisits); payloads are held against their digests."""
    files = max(1, index.select("file").distinct().count())
    placed = index.select("file", "offset", "length").repartitionByRange(files, "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT html, max(page_id) AS stored FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(sha1(p.html), 1 + 10 * (k // 8), 10))::BIGINT) >> (35 - 5 * (k % 8))) & 31)::INTEGER + 1, 1) for k in range(32)], '') AS payload_digest,
       CASE WHEN page_id = stored THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> stored THEN stored END AS refers_to
FROM p JOIN s USING (html)
"""


@query("op7_warc_archives", _SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    index = normalise(write_archives(table(spark, sf_dir, "pages"), scratch), scratch)
    return read_archives(index).drop("url", "payload")
