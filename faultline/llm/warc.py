"""WARC archives by way of a chunked record table (operator 2).

Payloads are cut where they are read into rows (record, chunk number) of at most ``CHUNK`` bytes that carry the
digest so far. Only these rows move, if anything does: equal payloads are found by their digests alone. Writers and
readers stream the rows and carry an incremental SHA-256, so none of them builds a whole record. Of equal payloads of at least
``MIN_REVISIT`` bytes the record with the smallest id is the response; the others are revisit records that refer
to it and hold no payload.

Writers put one file for each task and attempt under a folder that all executors share and return its name; only
the names of finished tasks reach the manifest, so a lost executor leaves at most a file that nobody reads.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, new_path, save, table, utf8

CHUNK = 1 << 16
MIN_REVISIT = 100
_BATCH = 1 << 22  # bytes of chunk rows that a task hands on at once
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKED = "record long, page_id long, url string, chunk_no long, n_chunks long, payload_bytes long, payload_digest string, sha256_so_far string, record_type string, refers_to long, chunk binary"
CUT = "record long, page_id long, url string, chunk_no long, n_chunks long, payload_bytes long, payload_digest string, sha256_so_far string, chunk binary"
#: Responses with copies (a digest and an id each) that may be broadcast.
MOST_BROADCAST = 1 << 17
READ = "page_id long, chunk_no long, n_bytes long, sha256_so_far string, last boolean, record_type string, refers_to long, payload_bytes long, chunk binary"


def _cut(chunk: int):
    """page_id, url, body to rows of ``CUT``; a record's number holds the task's in its upper bits."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in CUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, rows, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for page_id, url, body in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["body"]):
                view = memoryview(body.as_buffer())
                n = max(1, -(-len(view) // chunk))
                digest, sha = hashlib.sha256(view).hexdigest(), hashlib.sha256()
                for no in range(n):
                    part = view[no * chunk : (no + 1) * chunk]
                    sha.update(part)
                    rows.append((record, page_id, url, no, n, len(view), digest, sha.hexdigest(), bytes(part)))
                    size += len(part)
                    if size >= _BATCH or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                record += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def chunk_table(pages: DataFrame, chunk: int = CHUNK, page_id: str = "page_id", url: str = "url", payload: str = "html", most: int = MOST_BROADCAST) -> DataFrame:
    """Rows of ``CHUNKED``; a record's rows stand together and in order. Null payloads are empty: one empty chunk.

    A first pass over digests and ids finds the payloads that occur more than once. Up to ``most`` of them are
    broadcast, and no payload is shuffled; beyond, the chunk rows meet them by digest. A row given twice is two
    records. Of equal payloads under one smallest id, that id's rows are all responses. A null id counts as largest. Long payloads are cut into chunks. An empty table has no rows.
    """
    body = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), utf8(payload).alias("body"))
    first = (
        body.filter(F.octet_length("body") >= MIN_REVISIT)
        .groupBy(F.sha2("body", 256).alias("of"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("of", "first_id")
    )
    first = save(first, "warc-copies")
    cut = body.mapInArrow(_cut(chunk), CUT)
    if first.count() <= most:
        met = cut.join(F.broadcast(first), F.col("payload_digest") == F.col("of"), "left")
    else:
        # a record's rows come from one task, so they stay together where a hot digest is dealt out
        met = cut.join(first, F.col("payload_digest") == F.col("of"), "left").sortWithinPartitions("payload_digest", "record", "chunk_no")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    met = met.withColumn("revisit", revisit).filter("NOT revisit OR chunk_no = 0")
    return met.select(
        "record", "page_id", "url", "chunk_no", F.when(F.col("revisit"), 1).otherwise(F.col("n_chunks")).cast("long").alias("n_chunks"), "payload_bytes", "payload_digest", "sha256_so_far",
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("revisit"), F.col("first_id")).alias("refers_to"),
        F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("chunk")).alias("chunk"),
    )


def _head(page_id, url, kind: str, refers_to, size: int, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    held = len(http) + (size if kind == "response" else 0)
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {held}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_warc(chunks: DataFrame, folder: str) -> DataFrame:
    """Write a chunk table as gzip members, one for each record; returns the saved manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        path = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, records = None, 0
        for batch in batches:
            cols = [batch[c] for c in ("page_id", "url", "chunk_no", "n_chunks", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunk")]
            for i in range(batch.num_rows):
                page_id, url, no, n, size, digest, kind, refers, chunk = (c[i].as_py() for c in cols)
                out = out or fs.open_output_stream(path, compression=None)
                if no == 0:
                    pack, sha = zlib.compressobj(3, zlib.DEFLATED, 31), hashlib.sha256()
                    out.write(pack.compress(_head(page_id, url, kind, refers, size, digest)))
                sha.update(chunk)
                out.write(pack.compress(chunk))
                if no == n - 1:
                    if kind == "response" and sha.hexdigest() != digest:
                        raise ValueError(f"page {page_id}: chunks don't add up to the payload")
                    out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    records += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])

    return save(chunks.mapInArrow(run, "path string, records long"), "warc-manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], int]]:
    """Headers of each record, with the stream at its payload, and the payload's full length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        size = 0
        while (line := stream.readline()).strip():  # the HTTP head within the block
            k, _, v = line.decode().partition(":")
            size = int(v) if k.lower() == "content-length" else size
        yield head, size


def read_warc(manifest: DataFrame, folder: str, chunk: int = CHUNK, payload: bool = False) -> DataFrame:
    """Rows of ``READ`` from the files of a manifest: a digest so far for each chunk; chunks only if ``payload``."""

    def page(urn: str) -> int | None:
        x = urn.strip("<>").rpartition(":")[2]
        return None if x == "None" else int(x)

    def rows(fs, path: str) -> Iterator[tuple]:
        with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            for head, size in _records(stream):
                own, kind, declared = page(head["warc-record-id"]), head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                if kind == "revisit":
                    yield own, 0, 0, declared, True, kind, page(head["warc-refers-to"]), size, b""
                    continue
                sha, left, no = hashlib.sha256(), size, 0
                while True:
                    got = stream.read(min(chunk, left))
                    left -= len(got)
                    sha.update(got)
                    if left and not got or not left and sha.hexdigest() != declared:
                        raise ValueError(f"{path}: record {own} is damaged")
                    yield own, no, len(got), sha.hexdigest(), not left, kind, None, size, got if payload else None
                    no += 1
                    if not left:
                        break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch["path"].to_pylist():
                held: list[tuple] = []
                for row in rows(fs, path):
                    held.append(row)
                    if len(held) == (64 if payload else 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(run, READ)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = write_warc(chunk_table(table(spark, sf_dir, "pages").select("page_id", "url", "html")), folder)
    last = read_warc(manifest, folder).filter("last")
    return last.select("page_id", "payload_bytes", F.col("sha256_so_far").alias("payload_digest"), "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, min(page_id) AS first_id FROM p WHERE strlen(body) >= 100 GROUP BY body)
SELECT page_id, strlen(p.body) AS payload_bytes, sha256(p.body) AS payload_digest,
 CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (body)
"""
