"""Dense vectors: nearest neighbours, votes, components; and phrases."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialise
from . import sparse

PHRASES = 500


@cache
def stop_words() -> tuple[str, ...]:
    """Words left out of phrases: Spark's own English list."""
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


# ---- dense vectors ----


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _blocks(block: int):
    """id, embedding to blocks of at most ``block`` rows of one length: dims, ids, matrix (bytes). Null embeddings are blocks of length -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch["id"], batch["embedding"]
            lengths = pc.fill_null(pc.list_value_length(rows), -1).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                own = np.nonzero(lengths == d)[0]
                for at in range(0, len(own), block):
                    k = pa.array(own[at : at + block])
                    x = np.asarray(rows.take(k).flatten().to_numpy(zero_copy_only=False), np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids.take(k).to_pylist()], pa.list_(ids.type)), pa.array([x.tobytes()], pa.binary())], ["dims", "ids", "matrix"])

    return run


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first to the last entry as ``dot`` does."""
    s = np.zeros(len(x))
    for d in range(x.shape[1]):
        s += x[:, d] * y[:, d]
    return s


def _best(k: int):
    """Pairs of blocks (queries with a leading q_): each query's best ``k`` of the block.

    A matrix product tells who may be among them; their scores are then summed in order, as ``cosine`` does. Pairs
    without a score come last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, ids = batch["q_ids"][r].values, batch["ids"][r].values
                q_dims, dims = batch["q_dims"][r].as_py(), batch["dims"][r].as_py()
                x = np.frombuffer(batch["q_matrix"][r].as_buffer()).reshape(len(q_ids), max(q_dims, 0))
                y = np.frombuffer(batch["matrix"][r].as_buffer()).reshape(len(ids), max(dims, 0))
                place = np.empty(len(ids), np.int64)
                place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
                with np.errstate(all="ignore"):
                    xn, yn = np.sqrt(_in_order(x, x)), np.sqrt(_in_order(y, y))
                    xu, yu = x / xn[:, None], (y / yn[:, None]).T
                    for at in range(0, len(x), 256):
                        own = slice(at, at + 256)
                        score = xu[own] @ yu if q_dims == dims else np.full((len(x[own]), len(y)), np.nan)
                        score[np.isnan(score)] = -np.inf
                        least = np.partition(score, -min(k, len(y)), axis=1)[:, -min(k, len(y))]
                        i, j = np.nonzero(score >= least[:, None] - 1e-9)
                        same = _in_order(x[at + i], y[j]) / (xn[at + i] * yn[j]) if q_dims == dims else np.full(len(i), np.nan)
                        none = np.isnan(same)
                        order = np.lexsort((place[j], np.where(none, 0.0, -same), none, i))
                        i, j, same = i[order], j[order], same[order]
                        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                        i, j, same = i[keep], j[keep], same[keep]
                        yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at + i)), ids.take(pa.array(j)), pa.array(same, mask=np.isnan(same))], ["query_id", "vec_id", "score"])

    return run


def dense_top_k(vectors: DataFrame, query: DataFrame, k: int = 10, where: Column | None = None, most: int = 4096, block: int = 2000) -> DataFrame:
    """Nearest vectors of each query row: query_id, vec_id, score, rank. ``query`` (query_id, q) is stated and small.

    ``where`` filters before the search. Blocks of vectors meet blocks of queries as matrix products, and each keeps its
    own best before the shuffle. Pairs without a score (null, no length, other lengths) rank last. Up to ``most`` queries
    are broadcast; more go through in that many at a time, by blocks of their hash, so what is broadcast never grows.
    """
    n = query.count()
    if n > most:
        blocks = -(-n // most)
        part = F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks))
        return reduce(DataFrame.unionByName, (dense_top_k(vectors, query.filter(part == b), k, where, n, block) for b in range(2 * blocks)))
    v = (vectors if where is None else vectors.filter(where)).select(F.col("vec_id").alias("id"), "embedding")
    q = query.select(F.col("query_id").alias("id"), F.col("q").alias("embedding")).coalesce(1)  # at most ``most`` rows, so few blocks
    kind = lambda df: dict(df.dtypes)["id"]
    pack = lambda df: df.mapInArrow(_blocks(block), f"dims int, ids array<{kind(df)}>, matrix binary")
    asked = pack(q).select(*(F.col(c).alias(f"q_{c}") for c in ("dims", "ids", "matrix")))
    x = pack(v).join(F.broadcast(asked)).mapInArrow(_best(k), f"query_id {kind(q)}, vec_id {kind(v)}, score double")
    at = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return x.withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= k)


PACKED = "block long, ids binary, labels binary, matrix binary"
NEIGHBOUR = "q_id long, truth long, vec_id long, label long, score double"


def _pack(block: int):
    """vec_id, label, embedding to blocks of at most ``block`` rows of unit length, packed; null embeddings are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def packed() -> pa.RecordBatch:
            ids, labels, rows = zip(*held)
            x = np.array(rows, np.float64)
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), *(pa.array([np.array(c, np.int64).tobytes()], pa.binary()) for c in (ids, labels)), pa.array([x.tobytes()], pa.binary())], ["block", "ids", "labels", "matrix"]
            )

        for batch in batches:
            for start in range(0, batch.num_rows, block):  # a vector as a list of Python numbers takes eight times its bytes
                part = batch.slice(start, block)
                for row in zip(*(part[c].to_pylist() for c in ("vec_id", "label", "embedding"))):
                    if row[2] is not None:
                        held.append(row)
                        if len(held) == block:
                            yield packed()
                            number, held = number + 1, []
        if held:
            yield packed()

    return run


def _kth(score: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that its ``k``-th highest score reaches: of the maxima of 64 ranges of columns the ``k``-th highest."""
    n = score.shape[1]
    if n > 64 >= k:
        score = np.maximum.reduceat(score, np.arange(64) * n // 64, axis=1)
    m = min(k, score.shape[1])
    return np.partition(score, -m, axis=1)[:, -m]


def _nearest(k: int):
    """Pairs of blocks (columns of the second with a leading r_): each query's best ``k`` of the other block.

    Blocks are read where Arrow holds them: a batch may have as many pairs as fit its limit of bytes, and isn't copied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in NEIGHBOUR.split(", ")]
        for batch in batches:
            for r in range(batch.num_rows):
                q, v, truth, label, x, y = (np.frombuffer(batch[c][r].as_buffer(), t) for c, t in (("ids", "i8"), ("r_ids", "i8"), ("labels", "i8"), ("r_labels", "i8"), ("matrix", "f8"), ("r_matrix", "f8")))
                x, y = x.reshape(len(q), -1), y.reshape(len(v), -1)
                for at in range(0, len(q), 256):
                    score = x[at : at + 256] @ y.T
                    score[(q[at : at + 256, None] == v) | np.isnan(score)] = -np.inf
                    i, j = np.nonzero((score >= _kth(score, k)[:, None] - 1e-11) & (score > -np.inf))
                    # rounded, so that the order of a sum's terms doesn't decide between equal vectors
                    best = np.round(score[i, j], 12)
                    order = np.lexsort((v[j], -best, i))
                    i, j, best = i[order], j[order], best[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j, best = i[keep], j[keep], best[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q[at + i], truth[at + i], v[j], label[j], best)], names)

    return run


def knn_classify(vectors: DataFrame, k: int = 5, block: int = 2000) -> DataFrame:
    """Leave-one-out vote of the ``k`` nearest by cosine: vec_id, label, predicted, confidence.

    Exact, and so of the square of the rows: every block of vectors meets every block, as a product of two matrices that
    keeps each query's best ``k`` before anything is shuffled. Ties go to the smaller id, equal votes to the smaller
    label. Vectors that are null or of no length have no neighbours.
    """
    packed = materialise(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").mapInArrow(_pack(block), PACKED), "vectors")
    other = packed.select(*(F.col(c).alias(f"r_{c}") for c in packed.columns))
    x = packed.crossJoin(other).mapInArrow(_nearest(k), NEIGHBOUR)
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_n") <= k)
    votes = x.groupBy("q_id", "truth", "label").agg(F.count("*").alias("votes"), F.avg("score").alias("confidence"))
    best = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("votes"), "label"))
    return votes.withColumn("_n", best).filter("_n = 1").select(F.col("q_id").alias("vec_id"), F.col("truth").alias("label"), F.col("label").alias("predicted"), "confidence")


def knn_summary(predicted: DataFrame) -> DataFrame:
    """Accuracy, and the accuracy of always naming the most frequent label."""
    hit = predicted.agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    most = predicted.groupBy("label").count().agg(F.max("count").alias("most"))
    return hit.crossJoin(most).select("n", "accuracy", (F.col("most") / F.col("n")).alias("baseline"))


def per_class(predicted: DataFrame, least: int = 50) -> DataFrame:
    return predicted.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy")).filter(F.col("n") >= least)


def confusions(predicted: DataFrame, k: int = 10) -> DataFrame:
    return predicted.filter("label <> predicted").groupBy("label", "predicted").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "predicted").limit(k)


def by_band(predicted: DataFrame, edges=(0.0, 0.2, 0.4, 0.6, 0.8, 1.0)) -> DataFrame:
    """Accuracy by right-closed band of confidence."""
    band = F.when(F.lit(False), F.lit(0.0))
    for e in edges[1:]:
        band = band.when(F.col("confidence") <= e, F.lit(float(e)))
    return predicted.withColumn("upper", band).filter("upper IS NOT NULL").groupBy("upper").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's count, sums and products of its vectors, as one row."""
    n, total, product = 0, None, None
    for batch in batches:
        rows = [r for r in batch["embedding"].to_pylist() if r is not None]
        if rows:
            x = np.array(rows, np.float64)
            n, total, product = n + len(x), x.sum(axis=0) + (0 if total is None else total), x.T @ x + (0 if product is None else product)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary()), pa.array([product.tobytes()], pa.binary())], ["n", "total", "product"])


def pca_2d(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, y, x_share, y_share): centred vectors on their first two principal components, and the shares of the
    variance that these explain. A component's largest entry is positive. The driver holds a row of moments a task."""
    n, total, product = 0, 0.0, 0.0
    for r in vectors.select("embedding").mapInArrow(_moments, "n long, total binary, product binary").toLocalIterator():
        t = np.frombuffer(r.total)
        n, total, product = n + r.n, total + t, product + np.frombuffer(r["product"]).reshape(len(t), len(t))
    if not n:
        return vectors.select("vec_id", *(F.lit(None).cast("double").alias(c) for c in ("x", "y", "x_share", "y_share"))).filter("false")
    mean = total / n
    value, axis = np.linalg.eigh(product / n - np.outer(mean, mean))
    axis = axis[:, ::-1][:, :2]
    axis = axis * np.sign(axis[np.abs(axis).argmax(axis=0), np.arange(2)])
    share = value[::-1][:2] / max(value.sum(), 1e-300)
    at = lambda a: dot(F.col("embedding"), F.array(*map(F.lit, a.tolist()))) - float(mean @ a)
    return vectors.filter("embedding IS NOT NULL").select("vec_id", at(axis[:, 0]).alias("x"), at(axis[:, 1]).alias("y"), *(F.lit(float(v)).alias(c) for v, c in zip(share, ("x_share", "y_share"))))


def phrases(df: DataFrame, doc: str, text: str, limit: int = 30) -> DataFrame:
    """Two- and three-word phrases by mean TF-IDF over texts of three words or more; two documents at least.

    Stop words are Spark's English ones, a list of its own: phrases with a word on one list only differ from other tools'.
    """
    left_out = stop_words()
    w = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\b(\w\w+)\b")), lambda x: ~x.isin(*left_out))
    long = df.filter(F.size(F.split(F.trim(text), r"\s+")) >= 3).withColumn("_w", w)
    n = long.agg(F.count("*").alias("n"))
    weights = sparse.as_rows(*sparse.fit(long, doc, text, PHRASES, (2, 3), F.col("_w"), least_df=2))
    mean = weights.groupBy("term").agg(F.sum("w").alias("s"), F.count("*").alias("documents")).crossJoin(F.broadcast(n))
    return mean.filter(~F.contains("term", F.lit("redacted")) & ~F.col("term").rlike("^[0-9 ]+$")).select("term", "documents", (F.col("s") / F.col("n")).alias("score")).orderBy(F.desc("score"), "term").limit(limit)
