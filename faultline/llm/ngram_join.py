"""N-gram Jaccard self-join by signature trees (operator 7).

Documents with equal shingle sets form one class, of which only the least doc_id goes on. Every two sets with the
asked-for similarity share a shingle among the first few of each in one global order (frequent shingles last, else
by hash). Members of such a shingle's group are tied where their bitmaps and sizes leave a link possible, and the
components of these ties contain every link. Within a component, members are the leaves of a tree whose nodes hold
OR-combined bitmaps and size ranges; a traversal of node pairs drops those whose largest possible overlap is too
small, and what remains is counted exactly.

A shingle that more than ``BLOCK`` classes have in their prefix is not left there: the classes it touches are read
again, every shingle that more than ``BLOCK`` of them hold goes to the end of the one global order, and their
prefixes are taken anew. So a passage that many otherwise different documents share ties none of them, and only
documents that consist of such shingles for the most part, as large groups of near copies do, meet as a whole.

A component larger than ``BLOCK`` is dealt out in blocks: each block meets itself and a pivot block; members that
are still outside the component's largest group then meet every block. No link between different texts is lost,
and the copied rows grow with the outsiders and not with the square of a group of near copies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .exact_dedup import without_rows
from .shared import fmix, save, table, utf8

WORDS, PERCENT = 4, 85  # of op7; near-duplicate stages take five words and 80 percent
BUCKETS, CHUNKS = 1 << 20, 256  # hash buckets of the frequency table, and the parts it is summed in
BLOCK = 1000
#: Bytes of sets in a block, about; a set that is larger is a block of its own.
UNIT_BYTES = 32 << 20
HASHED = 26  # bits of the hashes that tell which texts are wanted: a bitmap of 8 MB at most
LEAF, FAN = 8, 8
FEW = 48  # members of a prefix shingle's group up to which they are compared one by one
MOST_COMMON = 1 << 20  # shingles of 8 bytes that may be broadcast
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of the whole sequence if it is shorter."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    out = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        out = (out ^ h[i : len(w) - k + 1 + i]) * _K[i % len(_K)] + np.uint64(i + 1)
        out ^= out >> np.uint64(29)
    return np.unique(fmix(out))


def prefix_length(n, percent: int):
    """Shingles of a set of n of which one at least is shared with every set it links to."""
    return n - -(-percent * n // 100) + 1


def _frequencies(words: int):
    """One packed count vector for each task and part of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingles(t.as_py(), words) for t in batch["text"][at : at + 256]]
                np.add.at(n, (np.concatenate(found) >> np.uint64(44)).astype(np.int64), np.uint32(1))
        packed = [zlib.compress(part.tobytes(), 1) for part in np.split(n, CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(packed, pa.binary())], ["part", "packed"])

    return run


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, packed in zip(batch["part"].to_pylist(), batch["packed"]):
            n = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32).astype(np.int64)
            sums[part] = sums[part] + n if part in sums else n
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "packed"])


def frequent_buckets(docs: DataFrame, words: int) -> np.ndarray:
    """Which of the hash buckets hold far more shingles than chance gives: one flag each, whatever the corpus."""
    counted = docs.select("text").mapInArrow(_frequencies(words), "part int, packed binary")
    n = np.zeros(BUCKETS)
    for row in counted.repartition("part").mapInArrow(_add_parts, "part int, packed binary").collect():  # CHUNKS rows
        size = BUCKETS // CHUNKS
        n[row.part * size : (row.part + 1) * size] = np.frombuffer(row.packed, np.int64)
    return n > n.mean() + 8 * np.sqrt(n.mean()) + 20


def bitmap_of(x: np.ndarray) -> bytes:
    """A bit for each shingle in a power of two of at least as many bits."""
    width = min(1 << 15, max(64, 1 << int(len(x) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(x & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


SETS = "doc_id long, sha string, n_shingles long, set_hash binary, prefix binary, bitmap binary"


def prefix_of(x: np.ndarray, late: np.ndarray, common: np.ndarray, percent: int) -> bytes:
    """The first shingles of a set in the global order: rare ones, those of frequent buckets, common ones; by hash."""
    back = late[(x >> np.uint64(44)).astype(np.int64)]
    if len(common):
        held = common[np.minimum(np.searchsorted(common, x), len(common) - 1)] == x
        parts = [x[~back & ~held], x[back & ~held], x[held]]
    else:
        parts = [x[~back], x[back]]
    return np.concatenate(parts)[: prefix_length(len(x), percent)].tobytes()


def shingle_table(docs: DataFrame, words: int, percent: int, frequent) -> DataFrame:
    """doc_id, sha (of the text), n_shingles, set_hash (null for an empty set), the prefix and the bitmap of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, none = frequent.value, np.zeros(0, np.uint64)
        for batch in batches:
            sizes, hashes, prefixes, bitmaps = [], [], [], []
            for text in batch["text"]:
                x = shingles(text.as_py(), words)
                sizes.append(len(x))
                hashes.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                bitmaps.append(bitmap_of(x) if len(x) else None)
                prefixes.append(prefix_of(x, late, none, percent) if len(x) else None)
            columns = [pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (hashes, prefixes, bitmaps))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["sha"], *columns], [x.split()[0] for x in SETS.split(", ")])

    return save(identified(docs).mapInArrow(run, SETS), "shingles")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, sha, text of every row; the first two tell all different documents apart, with or without an id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(utf8("text"), 256).alias("sha"), "text")


def _explode_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            ids, packed = batch["rep"][at : at + 256].to_numpy(), batch["prefix"][at : at + 256].to_pylist()
            tokens = np.frombuffer(b"".join(packed), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(ids, [len(p) // 8 for p in packed]))], ["token", "rep"])


def _fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width >>= 1
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


def _tie_few(rows: list[tuple[int, int, int, int]], percent: int) -> list[int]:
    """rows: (size, rep, width, bits) by size. A number for each, equal where a path of possible links exists."""
    root = list(range(len(rows)))
    for i, (n, _, width, bits) in enumerate(rows):
        own = bits.bit_count()
        for j in range(i + 1, len(rows)):
            m, _, other, theirs = rows[j]
            if 100 * n < percent * m:
                break  # sizes only grow
            if root[i] == root[j]:
                continue
            if other > width:
                theirs = _fold(theirs, other, width)
            common = (bits & theirs).bit_count()
            most = min(n - own + common, m - theirs.bit_count() + common)
            if (100 + percent) * most >= percent * (n + m):
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    return root


def _tie_many(rows: list[tuple[int, int, int, int]], percent: int) -> np.ndarray:
    """As ``_tie_few``, by a signature tree over the members of each bitmap width and the next one, folded."""
    widths = np.array([r[2] for r in rows])
    sizes = np.array([r[0] for r in rows], np.int64)
    root = np.arange(len(rows))
    for width in np.unique(widths).tolist():
        # similar sets differ in width by a factor of two at most
        at = np.flatnonzero((widths == width) | (widths == 2 * width))
        packed = b"".join(_fold(rows[k][3], rows[k][2], width).to_bytes(width // 8, "little") for k in at)
        bitmaps = np.frombuffer(packed, np.uint64).reshape(len(at), width // 64)
        order = np.lexsort((sizes[at], bitmaps[:, 0]))
        at, bitmaps = at[order], bitmaps[order]
        tree = _Tree(bitmaps, sizes[at])
        if len(at) < 2:
            continue
        li, lj = tree.pairs(percent) if len(at) > LEAF else (np.zeros(1, np.int64), np.zeros(1, np.int64))
        for part in np.array_split(np.arange(len(li)), max(1, len(li) // 4096)):
            i, j = tree.expand(1, li[part], lj[part])
            # two of the next width meet unfolded in their own turn
            keep = (i < j) & (root[at[i]] != root[at[j]]) & (np.minimum(widths[at[i]], widths[at[j]]) == width)
            i, j = i[keep], j[keep]
            keep = tree.possible(0, i, j, percent)
            u, v = at[i[keep]], at[j[keep]]
            while len(u):
                low = np.minimum(root[u], root[v])
                np.minimum.at(root, root[u], low)
                np.minimum.at(root, root[v], low)
                root = root[root]
                still = root[u] != root[v]
                u, v = u[still], v[still]
    while (root != root[root]).any():
        root = root[root]
    return root


def _tie_members(percent: int):
    """Rows sorted by token: token, rep, n, bitmap. Out: (u, v) so that every pair that may link is tied by a path."""

    def solve(rows: list[tuple[int, int, bytes]]) -> set[tuple[int, int]]:
        rows = sorted((n, rep, 8 * len(b), int.from_bytes(b, "little")) for rep, n, b in rows)
        root = _tie_few(rows, percent) if len(rows) <= FEW else _tie_many(rows, percent).tolist()
        first: dict[int, int] = {}
        ties = set()
        for k, r in enumerate(root):
            hub = first.setdefault(r, rows[k][1])
            if hub != rows[k][1]:
                ties.add((hub, rows[k][1]))
        return ties

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, held, ties = None, [], set()
        for batch in batches:
            for t, *row in zip(*(batch[c].to_pylist() for c in ("token", "rep", "n", "bitmap"))):
                if t != token:
                    if len(held) > 1:
                        ties |= solve(held)
                    token, held = t, []
                held.append(row)
            if len(ties) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ties)], ["u", "v"])
                ties = set()
        if len(held) > 1:
            ties |= solve(held)
        if ties:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ties)], ["u", "v"])

    return run


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a batch hold each shingle."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            token, n = np.unique(np.frombuffer(b"".join(batch["shingles"][at : at + 512].to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], ["token", "n"])


def _explode_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            ids, packed = batch["rep"][at : at + 256].to_numpy(), batch["shingles"][at : at + 256].to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(packed), np.int64)), pa.array(np.repeat(ids, [len(p) // 8 for p in packed]))], ["token", "rep"])


def _new_prefixes(frequent, percent: int, common=None):
    """rep, shingles (and held, the packed common ones among them, if they aren't broadcast) to rep, fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for batch in batches:
            fresh = []
            for k, packed in enumerate(batch["shingles"]):
                held = common.value if common is not None else np.sort(np.array(batch["held"][k].as_py() or (), np.int64).view(np.uint64))
                fresh.append(prefix_of(np.frombuffer(packed.as_py(), np.uint64), late, held, percent))
            yield pa.RecordBatch.from_arrays([batch["rep"], pa.array(fresh, pa.binary())], ["rep", "fresh"])

    return run


def prefix_tokens(reps: DataFrame, sets_of, frequent, percent: int, block: int, most: int = MOST_COMMON) -> DataFrame:
    """(token, rep) of the prefixes of ``reps`` (rep, prefix), with shingles held by more than ``block`` classes last.

    ``sets_of`` gives (rep, shingles) for a table of reps. Only classes with such a shingle in their prefix are read
    again: with all others, the first shingles of the old and the new order are the same. The common shingles are
    broadcast up to ``most`` of them, and joined beyond.
    """
    tokens = reps.mapInArrow(_explode_prefix, "token long, rep long")
    hot = save(tokens.groupBy("token").agg(F.count("*").alias("members")).filter(F.col("members") > block).select("token"), "hot")
    if hot.isEmpty():
        return tokens
    first = save(tokens.join(hot, "token", "left_semi").select("rep").distinct(), "touched")
    sets = sets_of(first)
    counts = sets.mapInArrow(_count_shingles, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    common = save(counts.filter(F.col("n") > block).select("token"), "common")
    also = tokens.join(common, "token", "left_semi").select("rep").distinct().join(first, "rep", "left_anti")
    sets = sets.unionByName(sets_of(also))
    if common.count() <= most:
        listed = np.sort(np.array([r.token for r in common.collect()], np.int64).view(np.uint64))  # at most ``most`` rows
        fresh = sets.mapInArrow(_new_prefixes(frequent, percent, reps.sparkSession.sparkContext.broadcast(listed)), "rep long, fresh binary")
    else:
        held = sets.mapInArrow(_explode_shingles, "token long, rep long").join(common, "token").groupBy("rep").agg(F.collect_list("token").alias("held"))  # bounded by the set
        fresh = sets.join(held, "rep", "left").mapInArrow(_new_prefixes(frequent, percent), "rep long, fresh binary")
    fresh = save(fresh.withColumnRenamed("fresh", "prefix"), "fresh")
    return tokens.join(fresh.select("rep"), "rep", "left_anti").select("token", "rep").unionByName(fresh.mapInArrow(_explode_prefix, "token long, rep long"))


def candidate_components(reps: DataFrame, tokens: DataFrame, percent: int, block: int) -> DataFrame:
    """``reps``: rep, n, bitmap; ``tokens``: token, rep. (rep, cluster) of those that may link with another.

    Members of a prefix shingle's group are tied by bitmaps; a group of more than ``block`` is tied as a whole. Of
    shingles with the same members, as near copies have many, one is enough.
    """
    shared = tokens.groupBy("token").agg(F.min("rep").alias("hub"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("rep")).alias("who")).filter("members > 1")
    shared = shared.groupBy("hub", "members", "who").agg(F.min("token").alias("token")).drop("who")
    met = save(tokens.join(shared, "token"), "shared")
    large = met.filter((F.col("members") > block) & (F.col("rep") != F.col("hub"))).select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct()
    small = met.filter(F.col("members") <= block).select("token", "rep").join(reps.select("rep", "n", "bitmap"), "rep")
    tied = small.select("token", "rep", "n", "bitmap").repartition("token").sortWithinPartitions("token").mapInArrow(_tie_members(percent), "u long, v long").distinct()
    found = save(components(save(tied.unionByName(large), "candidates")), "clustered")
    roots = found.select(F.col("component").alias("rep"), F.col("component").alias("cluster")).distinct()
    return save(found.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).unionByName(roots), "clusters")


class _Tree:
    """Levels from the members up to few nodes: bitmaps, least and largest size, fewest bits; (start, end) below."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray) -> None:
        bits = np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, bits)]
        self.starts: list[np.ndarray] = []
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            below, small, large, few = self.levels[-1]
            starts = np.arange(0, len(below), fan)
            self.starts.append(np.append(starts, len(below)))
            self.levels.append((np.bitwise_or.reduceat(below, starts), np.minimum.reduceat(small, starts), np.maximum.reduceat(large, starts), np.minimum.reduceat(few, starts)))
            fan = FAN

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether a pair below nodes i and j can still be similar enough."""
        bitmaps, small, large, few = self.levels[level]
        ok = (100 * large[i] >= percent * small[j]) & (100 * large[j] >= percent * small[i])
        at = np.flatnonzero(ok)
        for part in np.array_split(at, max(1, len(at) * bitmaps.shape[1] // (1 << 21))):
            a, b = i[part], j[part]
            common = np.bitwise_count(bitmaps[a] & bitmaps[b]).sum(axis=1, dtype=np.int64)
            # a bit of one side that the other lacks is a shingle that isn't shared
            most = np.minimum(large[a] - np.maximum(few[a] - common, 0), large[b] - np.maximum(few[b] - common, 0))
            ok[part] = (100 + percent) * most >= percent * (small[a] + small[b])
        return ok

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i <= j) of leaf nodes that no bound drops."""
        top = len(self.levels) - 1
        i = j = np.zeros(1, np.int64)
        for level in range(top, 1, -1):
            ok = self.possible(level, i, j, percent)
            i, j = self.expand(level, i[ok], j[ok])
        return i, j

    def expand(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ordered pairs of children of node pairs at ``level``."""
        starts = self.starts[level - 1]
        a, b = np.diff(starts)[i], np.diff(starts)[j]
        each = a * b
        own = np.repeat(np.arange(len(i)), each)
        k = np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)
        left, right = starts[i][own] + k // b[own], starts[j][own] + k % b[own]
        keep = left <= right
        return left[keep], right[keep]


def link_members(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """The group of each member after linking every similar pair: least group number of what it reaches.

    ``sets`` are sorted and distinct. Pairs that both have side 0 are left out, as are pairs of one group, whose
    link would change nothing.
    """
    order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
    sets, side, start = [sets[i] for i in order], side[order], group[order].copy()
    sizes = np.array([len(s) for s in sets], np.int64)
    width = min(1 << 14, max(1 << 10, 1 << int(2 * sizes.max() - 1).bit_length()))
    bitmaps = np.zeros((len(sets), width // 64), np.uint64)
    for row, s in zip(bitmaps, sets):
        bit = s & np.uint64(width - 1)
        np.bitwise_or.at(row, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    tree = _Tree(bitmaps, sizes)
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    dense = np.split(dense, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(sum(sizes)), np.uint8)
    now = start.copy()
    li, lj = tree.pairs(percent) if len(sets) > LEAF else (np.zeros(1, np.int64), np.zeros(1, np.int64))
    near = np.argsort(lj - li, kind="stable")
    for part in np.array_split(near, max(1, len(near) // 2048)):
        i, j = tree.expand(1, li[part], lj[part]) if len(sets) > 1 else (li[:0], lj[:0])
        keep = (i < j) & (now[i] != now[j]) & ((side[i] > 0) | (side[j] > 0))
        i, j = i[keep], j[keep]
        keep = tree.possible(0, i, j, percent)
        i, j = i[keep], j[keep]
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]
        for a, b in zip(*(np.searchsorted(i, np.unique(i), s) for s in ("left", "right"))):
            x, others = int(i[a]), j[a:b]
            others = others[now[others] != now[x]]
            for some in np.array_split(others, max(1, int(sizes[others].sum()) >> 22)):
                if not len(some):
                    continue
                mark[dense[x]] = 1
                ends = np.cumsum(sizes[some])
                common = np.add.reduceat(mark[np.concatenate([dense[y] for y in some])], ends - sizes[some], dtype=np.int64)
                mark[dense[x]] = 0
                for y in some[100 * common >= percent * (sizes[some] + sizes[x] - common)]:
                    g, h = now[x], now[y]
                    if g != h:
                        now[now == max(g, h)] = min(g, h)
    out = np.empty_like(now)
    out[order] = now
    return out


def _link_units(percent: int):
    """Rows sorted by unit: unit, side, rep, grp, shingles. Out: (u, v), a link between two groups."""

    def solve(reps, groups, sides, packed) -> Iterator[tuple[int, int]]:
        groups = np.array(groups, np.int64)
        after = link_members([np.frombuffer(p, np.uint64) for p in packed], groups, np.array(sides), percent)
        return {(int(a), int(b)) for a, b in zip(groups, after) if a != b}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, links = None, ([], [], [], []), []
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("unit", "rep", "grp", "side", "shingles")]
            for key, *row in zip(*cols):
                if key != unit:
                    if len(held[0]) > 1:
                        links += solve(*held)
                    unit, held = key, ([], [], [], [])
                for column, value in zip(held, row):
                    column.append(value)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["u", "v"])
                links = []
        if len(held[0]) > 1:
            links += solve(*held)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["u", "v"])

    return run


def _links(members: DataFrame, percent: int) -> DataFrame:
    dealt = members.select("unit", "side", "rep", "grp", "shingles").repartition("unit").sortWithinPartitions("unit", "rep")
    return dealt.mapInArrow(_link_units(percent), "u long, v long")


def _with_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``wanted`` (rep, cluster) with the classes' whole sets: rep, cluster, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [shingles(t.as_py(), words).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["cluster"], pa.array(packed, pa.binary())], ["rep", "cluster", "shingles"])

    named = save(wanted.join(classes.select("rep", "rep_id", "rep_sha"), "rep"), "named")
    # a bitmap of hashed digests, of at most 2 ** HASHED bits, keeps most texts that aren't wanted out of the shuffle
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << HASHED)) + 1
    bits = named.select(place("rep_sha").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    at = identified(docs).withColumn("p", place("sha")).withColumn("bucket", F.bitmap_bucket_number("p")).withColumn("bit", F.bitmap_bit_position("p"))
    octet = F.conv(F.hex(F.expr("substring(bits, CAST(bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    near = at.join(F.broadcast(bits), "bucket").filter(F.expr("shiftleft(1, CAST(bit % 8 AS INT))").bitwiseAND(octet) != 0).select("doc_id", "sha", "text")
    met = near.join(named.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("sha") == F.col("rep_sha"))).select("rep", "cluster", "text")
    return save(met.dropDuplicates(["rep"]).mapInArrow(run, "rep long, cluster long, shingles binary"), "members")


def linked_rows(docs: DataFrame, words: int, percent: int, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, sha (of the text), n_shingles, component (a number; null for an empty set)."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_buckets(docs, words))
    sets = shingle_table(docs, words, percent, frequent)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha"))
    classes = sets.filter("set_hash IS NOT NULL").groupBy("set_hash").agg(least.alias("least"), F.count("*").alias("copies"))
    classes = classes.select("set_hash", F.col("least.doc_id").alias("rep_id"), F.col("least.sha").alias("rep_sha"), "copies")
    # numbers of the saved table's rows, so that classes stay apart whatever ids they hold
    classes = save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    c = classes.select(F.col("set_hash").alias("h"), "rep_id", "rep_sha", "rep")
    s = sets.select("doc_id", "sha", F.col("n_shingles").alias("n"), "set_hash", "prefix", "bitmap")
    one = s.join(c.hint("merge"), (F.col("set_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("sha") == F.col("rep_sha")))
    one = save(one.select("rep", "n", "prefix", "bitmap").dropDuplicates(["rep"]), "one")
    sets_of = lambda reps: _with_sets(docs, classes, reps.withColumn("cluster", F.lit(0).cast("long")), words).drop("cluster")
    clusters = candidate_components(one, prefix_tokens(one.select("rep", "prefix"), sets_of, frequent, percent, block), percent, block)
    links = _verified(_with_sets(docs, classes, clusters, words), clusters, percent, block)
    linked = components(links)
    named = classes.join(linked, F.col("rep") == F.col("node"), "left").withColumn("more", (F.col("copies") > 1) | F.col("component").isNotNull())
    # a component's least class isn't a node of its own
    heads = linked.select(F.col("component").alias("rep")).distinct().withColumn("head", F.lit(True))
    named = named.join(heads, "rep", "left").filter("more OR head").select("set_hash", "rep_id", "rep_sha", F.coalesce("component", "rep").alias("component"))
    least = named.groupBy("component").agg(F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "rep_sha")).alias("least"))
    named = named.join(least, "component").select(F.col("set_hash").alias("h"), F.col("least.rep_id").alias("least_id"), F.col("least.rep_sha").alias("least_sha"))
    out = sets.select("doc_id", "sha", "n_shingles", "set_hash").join(named.hint("merge"), F.col("set_hash") == F.col("h"), "left")
    return out.select("doc_id", "sha", "n_shingles", "least_id", "least_sha")


def _verified(members: DataFrame, clusters: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (u, v) among ``members`` (rep, cluster, shingles) that tie all that true links tie."""
    heft = F.octet_length("shingles").cast("long")
    parts = lambda n, size: F.ceil(F.greatest(F.col(n) / F.lit(float(block)), F.col(size) / F.lit(float(UNIT_BYTES)))).cast("long")
    sized = members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(heft).alias("bytes")).withColumn("blocks", parts("size", "bytes")).drop("bytes")
    members = save(members.join(sized, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))), "dealt")
    # first: every block with itself and with block 0 of its component
    units = F.when(F.col("block") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    side = F.when((F.col("block") == 0) & (F.col("with") > 0), 0).otherwise(1).alias("side")
    first = members.withColumn("with", F.explode(units)).select(F.struct("cluster", "with").alias("key"), side, "rep", F.col("rep").alias("grp"), "shingles")
    named = lambda df: df.withColumn("unit", F.to_json("key")).drop("key")
    links = save(_links(named(first), percent), "links")
    large = members.filter("blocks > 1")
    if not large.isEmpty():
        # then: what is outside a large component's largest group with every block
        found = components(links).withColumnsRenamed({"node": "rep", "component": "grp"})
        large = save(large.join(found, "rep", "left").withColumn("grp", F.coalesce("grp", "rep")), "large")
        counts = large.groupBy("cluster", "grp").agg(F.count("*").alias("n"), F.sum(heft).alias("b"))
        first_of = F.struct("n", "grp")
        biggest = counts.groupBy("cluster").agg(F.max_by("grp", first_of).alias("biggest"), (F.sum("n") - F.max("n")).alias("out_n"), (F.sum("b") - F.max_by("b", first_of)).alias("out_b"))
        out = biggest.withColumn("out_blocks", parts("out_n", "out_b")).filter("out_n > 0")
        large = large.join(out.select("cluster", "biggest", "out_blocks"), "cluster")
        outside = large.filter("grp <> biggest").withColumn("o", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("out_blocks")))
        left = outside.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        left = left.select(F.struct("cluster", "o", "b").alias("key"), F.lit(0).alias("side"), "rep", "grp", "shingles")
        right = large.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("out_blocks") - 1)))
        right = right.select(F.struct("cluster", "o", F.col("block").alias("b")).alias("key"), F.lit(1).alias("side"), "rep", "grp", "shingles")
        links = links.unionByName(save(_links(named(left.unionByName(right)), percent), "links2"))
    return links


def similar_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Words are runs without ASCII white space, lower-cased in ASCII. Two documents link when 100 times the size of
    their sets' intersection is at least ``percent`` times that of the union. Null texts and texts without words
    have no shingles and link with nothing. Repeated rows get equal results. One id with two texts is two documents.
    A row without an id links like any other; its component_id is null if it reaches no row with an id. Links don't
    depend on order, so there are no ties to settle. Long texts have long sets: sets are dealt into blocks by their
    number and by their bytes. An empty table gives no rows.
    """
    alone = F.col("least_sha").isNull()
    return linked_rows(docs, words, percent, block).select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row of ``docs`` for each component, that with the least doc_id (ties: the least SHA-256); all columns stay.

    Rows without an id link like any other and give way to rows with one. Of rows that repeat id and text any one
    stays. One id with two texts is two documents. Null texts and texts without words link with nothing, so they
    stay. An empty table gives no rows.
    """
    rows = linked_rows(docs, words, percent, block).filter("least_sha IS NOT NULL")
    rows = rows.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("sha") == F.col("least_sha")))
    counted = save(rows.groupBy(F.col("doc_id").alias("gone_id"), F.col("sha").alias("gone_sha"), "stays").agg(F.count("*").alias("n")), "near")
    return without_rows(docs, counted.filter("NOT stays").select("gone_id", "gone_sha"), counted.filter("stays AND n > 1").select("gone_id", "gone_sha"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))
