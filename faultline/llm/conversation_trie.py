"""Prefix trie of conversations by union-find over sorted neighbours (operator 12).

Conversations become sequences of 16-byte turn digests, which sort as bytes and put every prefix before what extends it.
They are range-partitioned by (sequence, id), so copies of one conversation are dealt over many tasks. The length of the
prefix that two sorted neighbours share is an edge between them. A task walks its edges in descending depth and joins
components by union-find: a component that is complete at a depth gives the chain of nodes above it, every merge a
branching node. A partition's ends know their neighbours across the boundary: nodes on a path that a boundary cuts are
contracted to partial sums, all of which add up, and merged by the digest of their path; all other nodes are final.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import save, table

WIDTH = 16
#: Bytes of sequences that a partition holds, about.
PARTITION = 16 << 20
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256().hexdigest()
NODES = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, ends_sha256 string, ends binary, node binary, parent binary, part long"
_TYPES = [*[pa.int64()] * 7, pa.string(), *[pa.binary()] * 3, pa.int64()]
_NAMES = [c.split()[0] for c in NODES.split(", ")]


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): turns as structs of turn, digest (hex) and words, in order; equal turns by digest.

    Null role or text is empty. Rows without a conv_id belong to no conversation. A conversation is one row of some 50
    bytes a turn, as a text is one row; texts don't move.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_heads(sequences: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % group in place of its own first h; h is the CRC-32 of
    c's decimal digits modulo ``most``. A lead that is absent or short gives what it has."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    lead = sequences.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("lead"), F.slice("turns", 1, most - 1).alias("head"))
    x = sequences.withColumn("lead", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h).join(lead.hint("merge"), "lead", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return x.select("conv_id", F.concat(head, own).alias("turns"))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their beginning."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    if a[: hi * WIDTH] == b[: hi * WIDTH]:
        return hi
    while lo < hi - 1:  # the prefix of lo turns is equal, that of hi turns is not
        mid = (lo + hi) // 2
        if a[lo * WIDTH : mid * WIDTH] == b[lo * WIDTH : mid * WIDTH]:
            lo = mid
        else:
            hi = mid
    return lo


def _prefix_digests(seq: bytes, most: int) -> list[bytes]:
    """Digests of the prefixes of 0 to ``most`` turns."""
    sha = hashlib.sha256()
    out = [sha.digest()[:WIDTH]]
    for d in range(most):
        sha.update(seq[d * WIDTH : (d + 1) * WIDTH])
        out.append(sha.copy().digest()[:WIDTH])
    return out


def chains(edges: list[int], top: list[int], count: list[int], least: list[int]) -> list[list[int]]:
    """Chains of a partition's trie: [left, right, lo, hi, merges, count, least, parent].

    ``edges[j]`` is the depth shared by items j and j + 1, ``top``, ``count`` and ``least`` are an item's length, number
    of conversations and smallest id. A chain stands for the nodes at depths lo + 1 to hi above the items left to right;
    merges is the number of branches that joined at hi, parent the chain that ends at depth lo (-1: the root's).
    """
    m = len(top)
    root, left, right = list(range(m)), list(range(m)), list(range(m))
    top, count, least, merges = list(top), list(count), list(least), [0] * m
    waiting: list[list[int]] = [[] for _ in range(m)]
    out: list[list[int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def close(c: int, depth: int) -> None:
        """The chain of component ``c`` down to ``depth``."""
        if top[c] > depth:
            for k in waiting[c]:
                out[k][7] = len(out)
            waiting[c] = [len(out)]
            out.append([left[c], right[c], depth, top[c], merges[c], count[c], least[c], -1])
            top[c], merges[c] = depth, 0

    for j in sorted(range(m - 1), key=lambda j: -edges[j]):
        a, b = find(j), find(j + 1)
        close(a, edges[j])
        close(b, edges[j])
        if len(waiting[a]) < len(waiting[b]):
            waiting[a], waiting[b] = waiting[b], waiting[a]
        waiting[a] += waiting[b]
        root[b], right[a], waiting[b] = a, right[b], []
        count[a], least[a], merges[a] = count[a] + count[b], min(least[a], least[b]), merges[a] + 1
    if m:
        close(find(0), -1)
    return out


def _forest(key, items: pa.Table, bound: pa.Table) -> pa.Table:
    """The nodes of one partition. ``items``: conv_id, seq, words; ``bound``: part, before, after (the neighbours' sequences)."""
    part, before, after = (bound[c][0].as_py() for c in ("part", "before", "after"))
    seqs, ids = items["seq"].to_pylist(), items["conv_id"].to_pylist()
    order = sorted(range(len(seqs)), key=lambda i: (seqs[i], ids[i]))
    firsts = [k for k, i in enumerate(order) if k == 0 or seqs[i] != seqs[order[k - 1]]]
    runs = [[ids[i] for i in order[a:b]] for a, b in zip(firsts, [*firsts[1:], len(order)])]
    seq = [seqs[order[k]] for k in firsts]
    words = [items["words"][order[k]].values.to_numpy() for k in firsts]
    size = np.array([len(s) // WIDTH for s in seq], np.int64)
    b_prev = shared(before, seq[0]) if before is not None else -1
    b_next = shared(seq[-1], after) if after is not None else -1
    edges = [shared(a, b) for a, b in zip(seq[:-1], seq[1:])]
    p = np.array([b_prev, *edges], np.int64)
    q = np.array([*edges, b_next], np.int64)
    count = np.array([len(r) for r in runs], np.int64)
    found = np.array(chains(edges, size.tolist(), count.tolist(), [r[0] for r in runs]), np.int64).reshape(-1, 8)
    left, right, lo, hi, merges, n, least, parent = found.T

    # words of the first d turns of item i stand at start[i] + d
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    cum = np.concatenate([np.concatenate([[0], np.cumsum(w, dtype=np.int64)]) for w in words])
    whole = cum[start + size]
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    over = lambda x, a, b: sums(x)[b + 1] - sums(x)[a]
    said = over(count * whole, left, right)  # tokens of all members
    new = over(whole - cum[start + np.maximum(p, 0)], left + 1, right)  # tokens of nodes that later members bring
    leaves = over((q < size).astype(np.int64), left, right)

    # a row for each node: chain s, depth d
    s = np.repeat(np.arange(len(found)), hi - lo)
    d = np.arange(len(s)) - np.repeat(np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + lo[s] + 1
    i, up = left[s], np.maximum(d - 1, 0)
    mine = p[i]
    own = whole[i] - cum[start[i] + np.maximum(np.maximum(mine, up), 0)]
    saved = said[s] - n[s] * cum[start[i] + up] - new[s] - own
    kids = np.where(d == hi[s], merges[s], 0) + ((size[i] > d) & (d >= mine))
    above = np.where(d - 1 > lo[s], s, parent[s])
    cut = lambda c, depth: ((left[c] == 0) & (depth <= b_prev), (right[c] == len(seq) - 1) & (depth <= b_next))
    here, there = cut(s, d), cut(above, d - 1)
    digests = _prefix_digests(seq[0], b_prev), _prefix_digests(seq[-1], b_next)
    named = lambda c, depth: [digests[0][x] if a else digests[1][x] if b else None for a, b, x in zip(c[0].tolist(), c[1].tolist(), depth.tolist())]
    node, over_it = named(here, d), named(there, d - 1)
    top = d == 0
    for k in np.flatnonzero(top).tolist():
        over_it[k] = None
    ends: list[bytes | None] = [None] * len(s)
    digest: list[str | None] = [EMPTY] * len(s)
    for k in np.flatnonzero(d == size[i]).tolist():
        text = ",".join(map(str, runs[i[k]])).encode()
        if node[k] is None:
            digest[k] = hashlib.sha256(text).hexdigest()
        else:
            ends[k] = text
    known = ~top & ~(there[0] | there[1])
    rows = [
        pa.array(least[s]), pa.array(d), pa.array(n[s]), pa.array(kids), pa.array(leaves[s]), pa.array(saved), pa.array(least[above], mask=~known), pa.array(digest, pa.string()), pa.array(ends, pa.binary()),
        pa.array(node, pa.binary()), pa.array(over_it, pa.binary()), pa.array(np.full(len(s), part)),
    ]
    return pa.table([c.cast(t) for c, t in zip(rows, _TYPES)], _NAMES)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, part, ends) in order to one SHA-256 for each node; a list of ids goes through piece by piece."""
    at, sha = None, None
    for batch in batches:
        for node, ends in zip(batch["node"].to_pylist(), batch["ends"].to_pylist()):
            if node == at:
                sha.update(b",")
            else:
                if sha:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()])], ["e_node", "e_sha"])
                at, sha = node, hashlib.sha256()
            sha.update(ends)
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()])], ["e_node", "e_sha"])


def prefix_trie(sequences: DataFrame, size: int = PARTITION) -> DataFrame:
    """One row for each node of the trie of (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: structs with digest and words; ids are unique. A conversation without turns ends at the root. Copies of a
    conversation share all nodes. Very long conversations are one row each. An empty table has no nodes, not even a root.
    """
    spark = sequences.sparkSession
    flat = save(sequences.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words")), "sequences")
    total = flat.agg(F.coalesce(F.sum(F.octet_length("seq") + 64), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // size))
    dealt = save(flat.repartitionByRange(parts, "seq", "conv_id").select("*", F.spark_partition_id().cast("long").alias("part")), "sorted")
    end = dealt.groupBy("part").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    w = Window.orderBy("part")  # one row for each partition
    bounds = end.select("part", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"))
    nodes = save(dealt.groupBy("part").cogroup(bounds.groupBy("part")).applyInArrow(_forest, NODES), "nodes")
    cut = nodes.filter("node IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = cut.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.any_value("depth").alias("depth"), *sums, F.any_value("parent").alias("parent"))
    pieces = cut.filter("ends IS NOT NULL").select("node", "part", "ends").repartition("node").sortWithinPartitions("node", "part")
    hashed = pieces.mapInArrow(_hash_ends, "e_node binary, e_sha string")
    merged = save(merged.join(hashed, F.col("node") == F.col("e_node"), "left").withColumn("ends_sha256", F.coalesce("e_sha", F.lit(EMPTY))).drop("e_node", "e_sha"), "cut-nodes")
    out = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    final = nodes.filter("node IS NULL")
    # children of a cut node, of which the root may have very many: adaptive execution deals them out
    open_ = final.filter("parent IS NOT NULL").select(*out, "parent").unionByName(merged.select(*out, "parent"))
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    done = final.filter("parent IS NULL").select(*out, "parent_conv_id")
    return done.unionByName(open_.join(above.hint("merge"), "parent", "left").select(*out, "parent_conv_id"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_heads(save(turn_sequences(table(spark, sf_dir, "conversations")), "turns")))


OP12_SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i FROM o),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
 lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
b AS (SELECT c.conv_id, 0 AS part, i, k, words FROM c JOIN r ON r.conv_id = c.conv_id - c.conv_id % 20 AND i <= h UNION ALL SELECT r.conv_id, 1, i, k, words FROM r JOIN c USING (conv_id) WHERE i > h),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d FROM b),
p AS (SELECT conv_id, d, words, md5(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM t UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(d) AS len FROM p GROUP BY 1), x AS (SELECT p.*, len, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS up FROM p JOIN l USING (conv_id)),
n AS (SELECT key, any_value(d) AS depth, any_value(up) AS up, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends_sha256 FROM x GROUP BY key),
k AS (SELECT up AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1), m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key)),
s AS (SELECT a.key, count(*) FILTER (m.n_children = 0) AS n_leaves, CAST(sum((m.n_convs - 1) * m.words) AS BIGINT) AS saved_tokens FROM m JOIN x a ON a.conv_id = m.conv_id AND a.d <= m.depth GROUP BY 1)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256 FROM m JOIN s USING (key) LEFT JOIN n u ON u.key = m.up
"""
