"""Removal of repeated 400-byte strings with suffix arrays (operator 5).

Every window of ``SPAN`` bytes has one anchor: its least-hashed 32-byte gram (the leftmost on ties). Equal windows
have equal anchors at equal offsets, so they meet if regions, the runs of windows with one anchor, are brought
together by the anchor's hash. Anchors that occur once drop out. Regions with equal content are one region that is
repeated throughout. What is left goes to shards of bounded size, where a suffix array (Larsson-Sadakane prefix
doubling to depth ``SPAN`` in numpy) and Kasai's common prefixes find equal windows. An anchor with more regions
than a shard takes is dealt over several; their sorted windows are then merged by binary search.

Documents are known by a digest of their text throughout, so exact copies travel as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fmix, save, table, utf8

SPAN, GRAM = 400, 32
#: Regions of a shard; a region has up to 2 * SPAN bytes.
SHARD = 1500
_BUFFER = 1 << 20  # bytes that a task scans at once; longer texts are scanned in overlapping slices
#: Regions from which an anchor is hot, as a share of all: so at most 1000 are, and their broadcast is bounded.
HOT_SHARE = 1000
_POS = np.uint64((1 << 30) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each at least."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        got = _powers[base] = tuple(pair)
    return got


class Rolling:
    """64-bit hashes of any slices of a byte array; equal slices get equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, base: int) -> None:
        up, self.down = _power(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, start, end) -> np.ndarray:
        return fmix((self.sums[end] - self.sums[start]) * self.down[start])


def regions(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in documents that begin at ``starts`` in ``data``.

    (document number, first window within it, number of windows, anchor hash, two content hashes).
    """
    n = len(data)
    lens = np.diff(np.append(starts, n))
    w = SPAN - GRAM + 1
    if n < SPAN:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    first = Rolling(data, _BASES[0])
    at = np.arange(n - GRAM + 1)
    gram = first(at, at + GRAM)
    keys = (gram & ~_POS) | at.astype(np.uint64)
    padded = np.full(-(-len(keys) // w) * w + w, ~np.uint64(0))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    p = n - SPAN + 1
    anchor = (np.minimum(after[:p], before[w - 1 : w - 1 + p]) & _POS).astype(np.int64)
    doc = np.repeat(np.arange(len(starts)), lens)
    valid = doc[:p] == doc[SPAN - 1 :]
    head = valid.copy()
    head[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    tail = valid.copy()
    tail[:-1] &= head[1:] | ~valid[1:]
    lo, hi = np.flatnonzero(head), np.flatnonzero(tail) + SPAN
    second = Rolling(data, _BASES[1])
    d = doc[lo]
    return d, lo - starts[d], hi - lo - SPAN + 1, gram[anchor[lo]].view(np.int64), first(lo, hi).view(np.int64), second(lo, hi).view(np.int64)


def suffix_array(data: np.ndarray, depth: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes in order of their first ``depth`` bytes (over 8), ties in any order; ranks by position.

    Suffixes with equal first ``depth`` bytes have one rank.

    Larsson-Sadakane: groups of equal prefixes are split by the group of what follows, with doubled length each
    round; only suffixes in groups of two or more are sorted again.
    """
    n = len(data)
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    sa = np.argsort(key)
    # the end of the text sorts before any byte: ranks start at 1, and short suffixes are told apart below
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    slot = np.arange(n)
    group = np.maximum.accumulate(np.where(new, slot, 0))
    rank = np.zeros(n + depth + 8, np.int64)
    rank[sa] = group + 1
    h, alone = 8, new & np.append(new[1:], True)
    active = np.flatnonzero(~alone)
    while h < depth and len(active):
        step = min(h, depth - h)
        s = sa[active]
        pair = rank[s] * np.int64(n + 1) + rank[s + step]
        order = np.argsort(pair)
        s, pair = s[order], pair[order]
        sa[active] = s
        new = np.ones(len(active), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[s] = np.maximum.accumulate(np.where(new, active, 0)) + 1
        active = active[~(new & np.append(new[1:], True))]
        h += step
    return sa, rank[:n]


def kasai(data: np.ndarray, sa: np.ndarray, rank: np.ndarray, starts: np.ndarray, lens: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Common prefix, up to ``depth``, of each suffix in ``sa`` with the one before it there, by position.

    ``sa`` holds the suffixes of the runs of ``lens`` positions from ``starts`` on, or all of the text's. Kasai's walk in
    text order, where the next prefix is shorter by one at most, runs in lockstep over the runs. It begins at 0 again
    where the neighbour's successor isn't in ``sa``, and after a pair of one rank, which agrees to ``depth``: what lies
    past ``depth`` isn't ordered.
    """
    n = len(data)
    before = np.full(n + 1, -1)
    before[sa[1:]] = sa[:-1]
    inside = np.zeros(n + 1, bool)
    inside[sa] = True
    padded = np.append(data, np.zeros(depth + 16, np.uint8)).astype(np.uint64)
    word = np.zeros(n + depth + 8, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | padded[i : i + len(word)]
    by = np.argsort(-lens, kind="stable")
    starts, lens = starts[by], lens[by]
    out = np.zeros(n, np.int64)
    h = np.zeros(len(starts), np.int64)
    for t in range(int(lens.max(initial=0))):
        live = int(np.searchsorted(-lens, -t))
        i = starts[:live] + t
        j = before[i]
        same_rank = (j >= 0) & (rank[i] == rank[j])
        carry = inside[before[i - 1] + 1] & (h[:live] < depth) & (j >= 0) if t else False
        now = np.where(same_rank, depth, np.where(carry, np.maximum(h[:live] - 1, 0), 0))
        go = np.flatnonzero((j >= 0) & ~same_rank)
        while len(go):
            x = word[i[go] + now[go]] ^ word[j[go] + now[go]]
            whole = x == 0
            part = x[~whole]
            same = np.full(len(go), 8)
            # x under 256**k has 8 - k equal leading bytes
            same[~whole] = 8 - np.searchsorted(_BYTES, part, "right")
            now[go] = np.minimum(now[go] + same, np.minimum(depth, n - np.maximum(i[go], j[go])))
            go = go[whole]
            go = go[(now[go] < depth) & (np.maximum(i[go], j[go]) + now[go] < n)]
        h[:live] = now
        out[i] = now
    return out


_BYTES = np.array([1 << 8 * k for k in range(8)], np.uint64)


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


REGION = "key binary, start int, windows int, anchor long, c1 long, c2 long"
RANGE = "key binary, first int, past int"


def text_key(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()[:16]


def _scan(batches: Iterator[pa.RecordBatch], buffer: int = 0) -> Iterator[pa.RecordBatch]:
    """Regions of all bodies. A text over the buffer is scanned in slices that share ``SPAN`` - 1 bytes, so that each of
    its windows is seen once; a region that a slice's edge cuts is two with one anchor."""
    buffer = buffer or _BUFFER

    def flush(held: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        starts = np.cumsum([0] + [len(b) for *_, b in held[:-1]])
        d, start, windows, anchor, c1, c2 = regions(np.frombuffer(b"".join(b for *_, b in held), np.uint8), starts)
        keys = pa.array([k for k, *_ in held], pa.binary()).take(pa.array(d))
        start = start + np.array([at for _, at, _ in held], np.int64)[d]
        return pa.RecordBatch.from_arrays([keys, pa.array(start, pa.int32()), pa.array(windows, pa.int32()), pa.array(anchor), pa.array(c1), pa.array(c2)], ["key", "start", "windows", "anchor", "c1", "c2"])

    held, size = [], 0
    for batch in batches:
        for body in batch["body"]:
            body = body.as_py()
            if len(body) < SPAN:
                continue
            key = text_key(body)
            for at in range(0, len(body) - SPAN + 1, buffer):
                held.append((key, at, body[at : at + buffer + SPAN - 1]))
                size += len(held[-1][2])
                if size >= buffer:
                    yield flush(held)
                    held, size = [], 0
    if held:
        yield flush(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bodies with their regions (parts: start, windows, anchor, copies, unit, hot) to one row a region."""
    for batch in batches:
        keys, bodies, parts = batch["key"], batch["body"], batch["parts"]
        rows: list[tuple] = []
        for k in range(batch.num_rows):
            body, key = bodies[k].as_py(), keys[k].as_py()
            for p in parts[k].as_py():
                rows.append((key, p["start"], p["windows"], p["anchor"], p["copies"], p["unit"], p["hot"], body[p["start"] : p["start"] + p["windows"] + SPAN - 1]))
        if rows:
            types = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["key", "start", "windows", "anchor", "copies", "unit", "hot", "content"])


MERGE = "key binary, first int, past int, anchor long, part long, digests binary, owners binary"
_OWNER = np.dtype([("key", "S16"), ("at", "<i4"), ("open", "?")])


def _solve_shard(rows: list[tuple], hot: bool, parts: int) -> Iterator[tuple]:
    """Rows of ``MERGE``: ranges of repeated windows; for a hot anchor also its sorted windows for the merge."""
    contents = [r[5] for r in rows]
    data = np.frombuffer(b"".join(contents), np.uint8)
    starts = np.cumsum([0] + [len(c) for c in contents[:-1]])
    windows = np.array([r[2] for r in rows])
    sa, rank = suffix_array(data)
    window_starts = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    is_window = np.zeros(len(data), bool)
    is_window[window_starts] = True
    sa = sa[is_window[sa]]
    classes = np.cumsum(kasai(data, sa, rank, starts, windows)[sa] < SPAN)
    of = np.empty(len(data), np.int64)
    of[sa] = classes
    row_of = np.repeat(np.arange(len(rows)), windows)
    copies = np.array([r[4] for r in rows])
    known = of[window_starts]
    members = np.bincount(known, weights=np.minimum(copies, 2)[row_of], minlength=int(classes[-1]) + 1)
    repeated = (members[known] > 1) & (copies[row_of] == 1)
    ends = np.cumsum(windows)
    for k, (key, start, n, anchor, m, _) in enumerate(rows):
        if m == 1:
            for a, b in zip(*_ranges(repeated[ends[k] - n : ends[k]])):
                yield key, start + int(a), start + int(b), None, None, None, None
    if hot:
        hashes = Rolling(data, _BASES[0])(window_starts, window_starts + SPAN), Rolling(data, _BASES[1])(window_starts, window_starts + SPAN)
        _, one = np.unique(known, return_index=True)  # a window of each class
        high, low = hashes[0][one], hashes[1][one]
        own = np.zeros(len(one), _OWNER)
        at_row = row_of[one]
        own["key"] = np.array([r[0] for r in rows], "S16")[at_row]
        own["at"] = np.array([r[1] for r in rows])[at_row] + one - (ends - windows)[at_row]
        own["open"] = (members[known[one]] == 1) & (copies[at_row] == 1)
        part = (high % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((low, high, part))
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            pick = order[cuts[p] : cuts[p + 1]]
            if len(pick):
                yield None, None, None, rows[0][3], p, np.stack([high[pick], low[pick]], axis=1).tobytes(), own[pick].tobytes()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in MERGE.split(", ")]
    unit, held, out = None, [], []

    def solved() -> list[tuple]:
        return list(_solve_shard(held, unit[1] > 0, unit[1])) if len(held) > 1 or held and unit[1] else []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        cols = [batch[c].to_pylist() for c in ("unit", "hot_parts", "key", "start", "windows", "anchor", "copies", "content")]
        for u, parts, *row in zip(*cols):
            if (u, parts) != unit:
                out += solved()
                unit, held = (u, parts), []
                if len(out) > 5000:
                    yield batch_of(out)
                    out = []
            held.append(row)
    out += solved()
    if out:
        yield batch_of(out)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, part), one for each shard of a hot anchor: windows that two shards have."""

    def solve(digests: list[bytes], owners: list[bytes]) -> list[tuple]:
        shards = [np.frombuffer(d, np.dtype([("high", "<u8"), ("low", "<u8")])) for d in digests]
        # high parts of all shards in order; a low part settles the rare ties
        every = np.concatenate(shards)
        every = every[np.lexsort((every["low"], every["high"]))]
        rows = []
        for own, who in zip(shards, owners):
            who = np.frombuffer(who, _OWNER)
            lo, hi = np.searchsorted(every["high"], own["high"], "left"), np.searchsorted(every["high"], own["high"], "right")
            for k in np.flatnonzero((hi - lo > 1) & who["open"]):
                if (every["low"][lo[k] : hi[k]] == own["low"][k]).sum() > 1:
                    rows.append((bytes(who["key"][k]).ljust(16, b"\0"), int(who["at"][k]), int(who["at"][k]) + 1))
        return rows

    group, digests, owners, out = None, [], [], []
    for batch in batches:
        for a, p, d, o in zip(*(batch[c].to_pylist() for c in ("anchor", "part", "digests", "owners"))):
            if (a, p) != group:
                out += solve(digests, owners) if len(digests) > 1 else []
                group, digests, owners = (a, p), [], []
            digests.append(d)
            owners.append(o)
    out += solve(digests, owners) if len(digests) > 1 else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int32(), pa.int32()))], ["key", "first", "past"])


def repeated_windows(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """``docs``: key, body. Ranges (key, first, past) of starts of ``SPAN``-byte windows that start elsewhere too."""
    found = save(docs.select("body").mapInArrow(_scan, REGION), "regions")
    often = save(found.groupBy("anchor").agg(F.count("*").alias("seen")).filter("seen > 1"), "anchors")
    every = often.agg(F.sum("seen")).first()[0] or 0
    hot_anchors = F.broadcast(often.filter(F.col("seen") * HOT_SHARE > every).select("anchor"))  # under HOT_SHARE rows

    def by_anchor(rows: DataFrame, facts: DataFrame) -> DataFrame:
        """Inner join on the anchor; rows of hot ones stay where they are."""
        return rows.join(hot_anchors, "anchor", "left_anti").join(facts, "anchor").unionByName(rows.join(F.broadcast(facts.join(hot_anchors, "anchor", "left_semi")), "anchor"))

    found = save(by_anchor(found, often.select("anchor")), "anchored")
    content = ["anchor", "c1", "c2", "windows"]
    # equal regions become one, by partial sums before the shuffle
    kinds = save(found.groupBy(*content).agg(F.count("*").alias("copies"), F.min(F.struct("key", "start")).alias("at")), "kinds")
    whole = kinds.filter("copies > 1").select(*content)
    ranges = found.join(whole, content).select("key", F.col("start").alias("first"), (F.col("start") + F.col("windows")).alias("past")).distinct()
    spread = save(kinds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "spread")
    units = max(1, spread.agg(F.sum(F.when(F.col("n") <= shard, F.col("n")))).first()[0] or 0) // shard + 1
    open_ = by_anchor(kinds, spread).select("at.key", "at.start", "windows", "anchor", "copies", "n")
    hot = F.col("n") > shard
    parts = F.ceil(F.col("n") / F.lit(float(shard))).cast("long")
    open_ = open_.withColumn("hot", hot).withColumn("unit", F.when(hot, F.xxhash64("anchor", F.pmod(F.xxhash64("key", "start"), parts))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(units))))
    by_text = open_.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "anchor", "copies", "unit", "hot")).alias("parts"))  # bounded by the text
    bodies = docs.join(by_text.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("key", "body", "parts").dropDuplicates(["key"])
    cut = bodies.mapInArrow(_cut, "key binary, start int, windows int, anchor long, copies long, unit long, hot boolean, content binary")
    hot_parts = spread.filter(F.col("n") > shard).select(F.col("anchor").alias("a"), parts.alias("hot_parts"))
    cut = cut.join(hot_parts, F.col("anchor") == F.col("a"), "left").withColumn("hot_parts", F.when(F.col("hot"), F.col("hot_parts")).otherwise(0))
    solved = save(cut.drop("a", "hot").repartition("unit", "hot_parts").sortWithinPartitions("unit", "hot_parts", "key", "start").mapInArrow(_shards, MERGE), "shards")
    to_merge = solved.filter("key IS NULL").select("anchor", "part", "digests", "owners").repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    merged = to_merge.mapInArrow(_merge, RANGE)
    return ranges.unionByName(solved.filter("key IS NOT NULL").select("key", "first", "past")).unionByName(merged)


def covered_spans(ranges: list[tuple[int, int]], span: int = SPAN) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows that start in ``ranges``."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        end = b - 1 + span
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((a, end))
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for body, ranges in zip(batch["body"], batch["ranges"]):
            body = body.as_py()
            spans = covered_spans([(r["first"], r["past"]) for r in ranges.as_py() or ()])
            sha, at = hashlib.sha256(), 0
            for a, b in spans:
                sha.update(body[at:a])
                at = b
            sha.update(body[at:])
            rows.append((len(body), sum(b - a for a, b in spans), len(spans), sha.hexdigest()))
        cols = list(zip(*rows)) if rows else [()] * 4
        types = [pa.int64()] * 3 + [pa.string()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, shard: int = SHARD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay).

    A byte goes if a ``SPAN``-byte string over it also starts anywhere else, in the same text or another. Null texts
    count as empty. Rows with equal texts, repeated rows among them, lose all bytes of texts of SPAN bytes or more: there
    are no ties, as no copy is spared. Long texts are scanned in overlapping slices. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("body")).withColumn("key", F.unhex(F.substring(F.sha2("body", 256), 1, 32)))
    ranges = repeated_windows(rows.select("key", "body"), shard)
    listed = ranges.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("first", "past")).alias("ranges"))
    return rows.join(listed, F.col("key") == F.col("k"), "left").select("doc_id", "body", "ranges").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
