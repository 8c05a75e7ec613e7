"""Hierarchical multi-length packing (operator 4).

Documents are cut into full windows of the longest tier; what remains of each is routed to the shortest tier that
holds it. Tiers are packed from the longest to the shortest: a piece opens a window of its tier, the gap is filled
with the largest shorter pieces that fit, and a cut through the next larger piece closes it exactly. Sequences of
a block are dealt to step groups so that every group gets about the same number of tokens.

Packing is a narrow pass: a task packs its rows in blocks of ``block_tokens`` and pads at most its last sequence,
so nothing is shuffled, memory is bounded by a block, and no key can be hot.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .tokens import default_path, encoder, runs

TIERS = (1024, 512, 256, 128)
END = 0
BLOCK_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_TYPES = [pa.int64()] * 7 + [pa.int32(), pa.int64()]

#: (length, document's number in the block, start)
Piece = tuple[int, int, int]


def fill_windows(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(tier, pieces) of every full window, and the pieces that are left when the last gap can't be closed."""
    pool, done = sorted(pieces), []
    while pool:
        opener = pool.pop()
        tier = min(t for t in tiers if t >= opener[0])
        window, gap = [opener], tier - opener[0]
        while gap and pool:
            at = bisect_right(pool, (gap, 1 << 62, 0)) - 1
            if at >= 0:
                piece = pool.pop(at)
            else:
                n, doc, start = pool.pop(0)
                piece = (gap, doc, start)
                insort(pool, (n - gap, doc, start + gap))
            window.append(piece)
            gap -= piece[0]
        if gap:
            return done, window
        done.append((tier, window))
    return done, []


def step_groups(tiers: list[int], step_tokens: int) -> list[int]:
    """The number of each sequence's group: the next longest goes to the group with the fewest tokens."""
    heap = [(0, g) for g in range(-(-sum(tiers) // step_tokens))]
    out = [0] * len(tiers)
    for i in sorted(range(len(tiers)), key=lambda i: -tiers[i]):
        have, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (have + tiers[i], g))
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of a document of ``docs`` (doc_id, text): the columns of ``OUT``.

    Null texts count as empty: a document of the end id alone. Repeated rows are packed as often as they occur.
    Sequence ids hold the task's number in their upper bits; a task that runs again makes the same ones. Of equally good
    places the first is taken. Long texts are cut into pieces. An empty table gives no rows.
    """
    path, tiers = tokenizer or default_path(), tuple(sorted(tiers, reverse=True))
    longest = tiers[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base = encoder(path), TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, bytes]] = []  # the block's documents
        pool: list[Piece] = []
        full: list[tuple[int, list[Piece]]] = []
        sequence = group = tokens = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal sequence, group, held, pool, full, tokens
            packed, rest = fill_windows(pool, tiers)
            packed = full + packed
            if last and rest:
                packed.append((longest, rest))
                rest = []
            rows = []
            groups = step_groups([t for t, _ in packed], step_tokens)
            for (tier, window), g in zip(packed, groups):
                offset = 0
                for n, doc, start in window:
                    doc_id, ids = held[doc]
                    rows.append((doc_id, start, n, crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, base + sequence, offset, tier, base + group + g))
                    offset += n
                sequence += 1
            group += max(groups, default=-1) + 1
            keep = sorted({doc for _, doc, _ in rest})
            pool = [(n, keep.index(doc), start) for n, doc, start in rest]
            held, full, tokens = [held[d] for d in keep], [], 0
            names = [x.split()[0] for x in OUT.split(", ")]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names)

        for batch in batches:
            doc_ids, texts = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
            for part in runs(texts):
                for doc_id, ids in zip(doc_ids[part], coder.encode(texts[part])):
                    ids += END.to_bytes(4, "little")
                    n = len(ids) // 4
                    held.append((doc_id, ids))
                    whole = n - n % longest
                    full += [(longest, [(longest, len(held) - 1, at)]) for at in range(0, whole, longest)]
                    if n > whole:
                        pool.append((n - whole, len(held) - 1, whole))
                    tokens += n
                    if tokens >= block_tokens:
                        yield flush(False)
        if held:
            yield flush(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
