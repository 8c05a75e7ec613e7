"""Token ids in compressed binary files (operator 6).

File format. A file is a run of frames. A frame starts with ``MAGIC`` and two unsigned 32-bit counts, of document
entries and of blocks. An entry is (doc_id: signed 64-bit, ids in this frame: unsigned 32-bit, flags: one byte, of
which 1 says that the document ends here and 2 that it has no doc_id); entries are deflated together after their
size. Each block follows as (ids, bytes, CRC-32 of its ids as little-endian unsigned 32-bit integers) and the bytes
of the range coder. Blocks are coded independently of one another; all but a frame's last hold ``BLOCK_IDS`` ids.

Documents are range-partitioned and sorted by doc_id; each task writes one file and returns its name and its
number of ids, and only names of finished tasks reach the manifest. Running sums over the manifest, one row a
file, place each file's ids in the whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .range_coder import BLOCK_IDS, decode_blocks, encode_blocks
from .shared import file_system, new_path, save, table
from .tokens import default_path, encoder, runs

MAGIC = b"TIDS1\0\0\0"
END = 2
#: Blocks that are coded in lockstep, and so held in memory by a task.
LANES = 1024
_ENTRY = struct.Struct("<qIB")
MANIFEST = "file_no long, path string, ids long, documents long"
READ = "file_no long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _frame(entries: list[tuple[int | None, int, bool]], ids: np.ndarray) -> bytes:
    whole = len(ids) // BLOCK_IDS
    groups = [ids[: whole * BLOCK_IDS].reshape(whole, BLOCK_IDS)] if whole else []
    if len(ids) % BLOCK_IDS:
        groups.append(ids[whole * BLOCK_IDS :].reshape(1, -1))
    index = zlib.compress(b"".join(_ENTRY.pack(d or 0, n, last + 2 * (d is None)) for d, n, last in entries), 3)
    out = [MAGIC, struct.pack("<III", len(entries), whole + bool(len(ids) % BLOCK_IDS), len(index)), index]
    for group in groups:
        for row, code in zip(group, encode_blocks(group)):
            out += [struct.pack("<III", len(row), len(code), zlib.crc32(row.astype("<u4").tobytes())), code]
    return b"".join(out)


def _frames(stream) -> Iterator[tuple[list[tuple[int | None, int, bool]], np.ndarray]]:
    def take(n: int) -> bytes:
        got = stream.read(n)
        if len(got) != n:
            raise ValueError("the file ends within a frame")
        return bytes(got)

    while magic := stream.read(len(MAGIC)):
        if magic != MAGIC:
            raise ValueError("no frame starts here")
        n_docs, n_blocks, size = struct.unpack("<III", take(12))
        entries = [(None if flags & 2 else d, n, bool(flags & 1)) for d, n, flags in _ENTRY.iter_unpack(zlib.decompress(take(size)))]
        if len(entries) != n_docs:
            raise ValueError("the frame's index is damaged")
        blocks = []
        for _ in range(n_blocks):
            n, size, crc = struct.unpack("<III", take(12))
            blocks.append((n, crc, take(size)))
        ids = []
        for length in dict.fromkeys(n for n, _, _ in blocks):  # at most two lengths, the shorter last
            group = [b for b in blocks if b[0] == length]
            rows = decode_blocks([code for _, _, code in group], length).astype("<u4")
            for (_, crc, _), row in zip(group, rows):
                if zlib.crc32(row.tobytes()) != crc:
                    raise ValueError("a block doesn't match its checksum")
                ids.append(row)
        yield entries, np.concatenate(ids) if ids else np.zeros(0, "<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, lanes: int = LANES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files under ``folder`` in ascending doc_id order; the saved manifest.

    Null texts count as empty: the end id alone. Null doc_ids come first. Repeated rows are written each time; rows of
    one id stand in the order of their texts' hashes. Long texts go through in frames. An empty table has no files.
    """
    path_of_tokenizer, frame_ids = tokenizer or default_path(), lanes * BLOCK_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out, total, documents = encoder(path_of_tokenizer), None, 0, 0
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        no = TaskContext.get().partitionId()
        path = f"{base}/part-{no:06d}-{uuid.uuid4().hex}.tids"
        entries: list[tuple[int | None, int, bool]] = []
        held, size = [], 0
        for batch in batches:
            doc_ids, texts = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
            for part in runs(texts):
                for doc_id, raw in zip(doc_ids[part], coder.encode(texts[part])):
                    ids = np.frombuffer(raw + end.to_bytes(4, "little"), "<u4")
                    documents += 1
                    total += len(ids)
                    while len(ids):
                        now, ids = ids[: frame_ids - size], ids[frame_ids - size :]
                        entries.append((doc_id, len(now), not len(ids)))
                        held.append(now)
                        size += len(now)
                        if size == frame_ids:
                            out = out or fs.open_output_stream(path, compression=None)
                            out.write(_frame(entries, np.concatenate(held)))
                            entries, held, size = [], [], 0
        if size:
            out = out or fs.open_output_stream(path, compression=None)
            out.write(_frame(entries, np.concatenate(held)))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([no]), pa.array([path]), pa.array([total]), pa.array([documents])], ["file_no", "path", "ids", "documents"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # one id that very many rows repeat is dealt over tasks by its texts
    rows = rows.withColumn("said", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "said").sortWithinPartitions("doc_id", "said", "text").drop("said")
    return save(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Each document of the manifest's files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        names = [x.split()[0] for x in READ.split(", ")]
        for batch in batches:
            for no, path in zip(batch["file_no"].to_pylist(), batch["path"].to_pylist()):
                start = n_tokens = crc = 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for entries, ids in _frames(stream):
                        rows, at = [], 0
                        for doc_id, n, last in entries:
                            crc = zlib.crc32(ids[at : at + n].tobytes(), crc)
                            at, n_tokens = at + n, n_tokens + n
                            if last:
                                rows.append((no, doc_id, start, n_tokens, crc))
                                start, n_tokens, crc = start + n_tokens, 0, 0
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    files = max(1, manifest.count())
    before = F.sum("ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("file_no", F.coalesce(before, F.lit(0)).alias("file_start"))  # one row a file
    found = manifest.select("file_no", "path").repartition(files).mapInArrow(run, READ)
    return found.join(placed, "file_no").select("doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tids")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder), folder)
