"""Ranked lexical search over a document FP-tree (operator 13).

A first pass reduces every text to its length and the frequencies of the query set's terms in it. These restricted
vectors, written as paths of terms from the most to the least frequent one, are range-partitioned, so that a task holds
one stretch of the trie that all paths make up and neighbours share long paths. A task takes its stretch in blocks of
bounded memory. In a block the trie's nodes carry the largest frequency of each term and the smallest length norm of
their documents, which bound every score below; each item is answered by depth-first branch and bound, best child first,
against the scores it has found so far. A leaf is a few neighbouring paths, scored exactly. The best of all tasks meet
in one ranking.

All scores are 64-bit integers, so ranks don't depend on partitions.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import save, table, utf8

#: Length norms: m = FLOOR + SLOPE * length / mean length; FLOOR and SLOPE add up to 100.
FLOOR, SLOPE = 10, 90
MOST_ITEMS, MOST_TERMS = 4096, 1 << 17
#: Cells (documents x terms) of a block, documents of a block and of a leaf.
CELLS, BLOCK, LEAF = 1 << 24, 4096, 24
#: Bytes of a path (four a term) that decide which task takes it.
STEM = 64
_SLICE = 1 << 20
#: Bytes that part terms become blanks, A-Z become lower case; bytes of other characters stay.
_FOLD = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(body: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in slices that bound the memory of long texts."""
    body, at = body.translate(_FOLD), 0
    while at < len(body):
        end = len(body) if len(body) - at <= _SLICE else body.rfind(b" ", at, at + _SLICE) + 1
        if end <= at:  # a term longer than a slice
            end = body.find(b" ", at + _SLICE) + 1 or len(body)
        yield body[at:end].split()
        at = end


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, t) for i, body in zip(batch["item_id"].to_pylist(), batch["body"].to_pylist()) for t in {t for part in terms(body) for t in part}]
        ids, found = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["item_id", "term"])


def _vectors(vocabulary):
    """doc_id, body to doc_id, length in terms, numbers and frequencies of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(vocabulary.value)}.get
        for batch in batches:
            n, own, tfs = [], [], []
            for body in batch["body"]:
                found, length = Counter(), 0
                for part in terms(body.as_py()):
                    length += len(part)
                    found.update(map(number, part))
                found.pop(None, None)
                n.append(length)
                own.append(list(found))
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return run


def _paths(rank, docs: int, total: int):
    """Vectors to paths: ranks as big-endian 32-bit numbers in ascending order, so that bytes sort as the trie does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = np.asarray(rank.value, np.int64)
        for batch in batches:
            keep, m, paths, tfs = [], [], [], []
            for k, (n, own, tf) in enumerate(zip(batch["n"].to_pylist(), batch["terms"], batch["tfs"])):
                if len(own):
                    r, f = to[own.values.to_numpy()], tf.values.to_numpy()
                    order = np.argsort(r)
                    keep.append(k)
                    m.append(FLOOR + SLOPE * n * docs // total)
                    paths.append(r[order].astype(">u4").tobytes())
                    tfs.append(f[order].astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(keep, pa.int64())), pa.array(m, pa.int64()), pa.array(paths, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "m", "path", "tfs"])

    return run


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a score: it grows with tf and falls with m, so maxima and minima bound it."""
    return 1_000_000_000 * tf // np.maximum(1000 * tf + 8 * m, 1)


class Tree:
    """The trie of a block of documents whose paths are sorted: nodes as arrays, children of a node side by side."""

    def __init__(self, paths: list[bytes], tfs: list[bytes], m: np.ndarray, leaf: int = LEAF):
        lengths = np.fromiter((len(p) // 4 for p in paths), np.int64, len(paths))
        ranks = np.frombuffer(b"".join(paths), ">u4").astype(np.int64)
        self.columns, own = np.unique(ranks, return_inverse=True)
        self.tf = np.zeros((len(paths), len(self.columns)), np.int64 if len(paths) <= 64 else np.int32)
        values = np.frombuffer(b"".join(tfs), np.int64)
        if len(values) and values.max() >= 1 << 31:
            self.tf = self.tf.astype(np.int64)
        self.tf[np.repeat(np.arange(len(paths)), lengths), own] = values
        self.m = m
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        spans, kids, todo = [(0, len(paths))], [], [0]
        for node in todo:  # breadth first: the list grows while it is walked
            lo, hi = spans[node]
            parts = [] if hi - lo <= leaf else self._split(paths, ranks, start, lengths, lo, hi, leaf)
            kids.append((len(spans), len(spans) + len(parts)))
            todo.extend(range(len(spans), len(spans) + len(parts)))
            spans += parts
        self.spans, self.kids = spans, kids
        self.most = np.zeros((len(spans), len(self.columns)), self.tf.dtype)
        self.least = np.zeros(len(spans), np.int64)
        for node in range(len(spans) - 1, -1, -1):
            (lo, hi), (a, b) = spans[node], kids[node]
            self.most[node] = self.most[a:b].max(axis=0) if a < b else self.tf[lo:hi].max(axis=0)
            self.least[node] = self.least[a:b].min() if a < b else m[lo:hi].min()

    @staticmethod
    def _split(paths, ranks, start, lengths, lo: int, hi: int, leaf: int) -> list[tuple[int, int]]:
        """Spans of the branches below the path that all documents of a span share; small neighbours stay together."""
        a, b = (np.frombuffer(paths[i], ">u4") for i in (lo, hi - 1))
        k = min(len(a), len(b))
        differ = np.flatnonzero(a[:k] != b[:k])
        depth = int(differ[0]) if len(differ) else k
        longer = lengths[lo:hi] > depth
        at = np.where(longer, ranks[np.minimum(start[lo:hi] + depth, len(ranks) - 1)], -1)
        cuts = lo + np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [hi - lo]])
        out: list[tuple[int, int]] = []
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if out and y - out[-1][0] <= leaf:
                out[-1] = (out[-1][0], y)
            elif at[x - lo] < 0 or (x, y) == (lo, hi):  # equal paths have no branch of their own
                out += [(i, min(i + leaf, y)) for i in range(x, y, leaf)]
            else:
                out.append((x, y))
        return out

    def search(self, ranks: np.ndarray, weights: np.ndarray, ids: list, best: list[tuple], k: int) -> list[tuple]:
        """``best`` (negative score, id is null, id), sorted, with what this tree adds to the ``k`` first."""
        at = np.searchsorted(self.columns, ranks)
        here = (at < len(self.columns)) & (self.columns[np.minimum(at, len(self.columns) - 1)] == ranks)
        at, weights = at[here], weights[here]
        if not len(at):
            return best
        bound = (gain(self.most[:, at].astype(np.int64), self.least[:, None]) @ weights).tolist()
        stack = [0]
        while stack:
            node = stack.pop()
            floor = -best[-1][0] if len(best) == k else 1
            if bound[node] < floor:
                continue
            a, b = self.kids[node]
            if a < b:
                stack += sorted(range(a, b), key=bound.__getitem__)
                continue
            lo, hi = self.spans[node]
            score = gain(self.tf[lo:hi][:, at].astype(np.int64), self.m[lo:hi, None]) @ weights
            hits = np.flatnonzero(score >= floor)
            if len(hits):
                best = sorted([*best, *((-int(score[i]), ids[lo + i] is None, ids[lo + i] or 0) for i in hits)])[:k]
        return best


def _search(items, k: int, width: int):
    """Sorted paths to each item's best ``k`` of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(i, np.asarray(r, np.int64), np.asarray(w, np.int64)) for i, r, w in items.value]
        best: list[list[tuple]] = [[] for _ in asked]
        most = max(LEAF, min(BLOCK, CELLS // max(1, width)))
        held: list[tuple] = []

        def answer() -> None:
            ids, m, paths, tfs = zip(*held)
            tree = Tree(paths, tfs, np.asarray(m, np.int64))
            for j, (_, ranks, weights) in enumerate(asked):
                best[j] = tree.search(ranks, weights, ids, best[j], k)

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "m", "path", "tfs"))):
                held.append(row)
                if len(held) == most:
                    answer()
                    held = []
        if held:
            answer()
        rows = [(i, None if null else d, -s) for (i, *_), own in zip(asked, best) for s, null, d in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["item_id", "doc_id", "score"])

    return run


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", most: int = MOST_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents, with score above 0.

    Every row of ``docs`` is a document; one given twice is ranked twice. Null and empty texts have no terms and are
    never found. Equal scores go by ascending doc_id, rows without an id last. Rows of one item_id are one item, whose
    terms count once; those without an id are one item too. Items without known terms have no rows, nor has an empty
    table of either kind. Long texts are read in slices. Columns beyond the named ones are not looked at.

    Items go through in blocks of at most ``most`` items: a block's terms and weights are held by the driver and every
    task, so what is broadcast doesn't grow with documents or with items.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), utf8(item_text).alias("body")).mapInArrow(_item_terms, "item_id long, term binary").groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    asked = save(asked, "items")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("t")).first()
    blocks = 1 if size.n <= most and size.t <= MOST_TERMS else 2 * max(-(-size.n // most), -(-size.t // MOST_TERMS))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("body"))
    parts = [_block(spark, d, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    at = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    rows = [(r.item_id, [bytes(t) for t in r.terms]) for r in items.collect()]
    vocabulary = sorted({t for _, own in rows for t in own})
    vectors = save(docs.mapInArrow(_vectors(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms array<int>, tfs array<long>"), "vectors")
    s = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # as many as the block has terms
        df[r.t] = r.df
    order = np.lexsort((np.arange(len(df)), -df))
    rank = np.empty(len(df), np.int64)
    rank[order] = np.arange(len(df))
    weight = [math.floor(1000 * math.log((2 * s.docs + 2) / (2 * int(x) + 1))) for x in df]
    number = {t: j for j, t in enumerate(vocabulary)}
    asked = []
    for i, own in rows:
        js = [j for t in own if df[j := number[t]] and weight[j] > 0]
        asked.append((i, [int(rank[j]) for j in js], [weight[j] for j in js]))
    paths = vectors.select("doc_id", "n", "terms", "tfs").mapInArrow(_paths(spark.sparkContext.broadcast(rank.tolist()), s.docs, max(1, s.total)), "doc_id long, m long, path binary, tfs binary")
    # ranges by the stem, as the driver holds sampled keys of all partitions to find their bounds
    trie = paths.withColumn("stem", F.substring("path", 1, STEM)).repartitionByRange("stem", "doc_id").sortWithinPartitions("path").drop("stem")
    return trie.mapInArrow(_search(spark.sparkContext.broadcast(asked), k, int((df > 0).sum())), "item_id long, doc_id long, score long")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents), c AS (SELECT r, doc_id, len(w) AS n FROM d),
s AS (SELECT count(*) FILTER (n > 0) AS docs, CAST(sum(n) AS BIGINT) AS total FROM c),
it AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark), v AS (SELECT DISTINCT term FROM it),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) JOIN v USING (term) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s GROUP BY term, docs),
sc AS (SELECT item_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * ({FLOOR} + ({SLOPE} * n * docs) // total)))) AS BIGINT) AS score
 FROM it JOIN wt USING (term) JOIN tf USING (term) JOIN c USING (r), s GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM sc JOIN c USING (r) WHERE score > 0 QUALIFY rank <= 10
"""
