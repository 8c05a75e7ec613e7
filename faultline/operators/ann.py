"""Approximate nearest vectors: cells around centroids, residuals in a byte a dimension, exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import new_folder
from .vectors import cosine

#: Vectors that centroids are fitted on, at most: those of the least hashes of their ids.
SAMPLE = 20_000
CELLS, PROBES, RERANK = 64, 44, 8
ROUNDS, QUERIES = 12, 512


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)


def _centroids(x: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from a fixed start: every n-th vector of the sample."""
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = np.bincount(own, minlength=len(c)) > 0
        c[full] = _unit(sums[full])
    return c


class Index:
    """A written table of vec_id, label, cell and code, in folders by cell, with what its codes mean."""

    def __init__(self, table: DataFrame, centroids: np.ndarray, scale: np.ndarray):
        self.table, self.centroids, self.scale = table, centroids, scale


def build(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> Index:
    """``vectors``: vec_id, label, embedding. Every row with an embedding of some length is stored, in the cell whose
    centroid is nearest by angle, as its residual in units of the sample's largest one. The sample alone is bounded."""
    spark = vectors.sparkSession
    some = vectors.filter("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    x = _unit(np.array([r.embedding for r in some], np.float64)) if some else np.zeros((0, 0))
    x = x[~np.isnan(x).any(axis=1)]
    c = _centroids(x, cells) if len(x) else np.zeros((0, 0))
    scale = np.abs(x - c[(x @ c.T).argmax(axis=1)]).max(axis=0) / 127 + 1e-12 if len(x) else np.zeros(0)
    put = spark.sparkContext.broadcast((c, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, scale = put.value
        for batch in batches:
            got = [(i, la, e) for i, la, e in zip(*(batch[n].to_pylist() for n in ("vec_id", "label", "embedding"))) if e is not None]
            if not got:
                continue
            v = _unit(np.array([e for *_, e in got], np.float64))
            ok = ~np.isnan(v).any(axis=1)
            v, got = v[ok], [g for g, k in zip(got, ok) if k]
            own = (v @ c.T).argmax(axis=1)
            codes = np.clip(np.rint((v - c[own]) / scale), -127, 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array(own, pa.int32()), pa.array([x.tobytes() for x in codes], pa.binary())], ["vec_id", "label", "cell", "code"])

    path = new_folder(spark, "cells")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").mapInArrow(run, "vec_id long, label long, cell int, code binary")
    rows.write.partitionBy("cell").parquet(path)
    return Index(spark.read.schema("vec_id long, label long, code binary, cell int").parquet(path), c, scale)


def search(index: Index, vectors: DataFrame, queries: DataFrame, k: int = 10, where: str | None = None, probes: int = PROBES, rerank: int = RERANK) -> DataFrame:
    """(query_id, vec_id, score, rank): nearly the ``k`` nearest vectors of each query (query_id, q) by cosine.

    A query looks at its ``probes`` nearest cells, keeps the ``rerank * k`` best by code of each cell and then of all,
    and ranks those by their exact vectors. ``where`` filters the table before anything is ranked. Queries meet a cell in
    portions, and a cell's rows in the batches they come in, so no task holds a whole cell.
    """
    spark = vectors.sparkSession
    if not len(index.centroids):
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    put, many = spark.sparkContext.broadcast((index.centroids, index.scale)), rerank * k

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, _ = put.value
        for batch in batches:
            got = [(i, q) for i, q in zip(batch["query_id"].to_pylist(), batch["q"].to_pylist()) if q is not None]
            v = _unit(np.array([q for _, q in got], np.float64).reshape(len(got), -1)) if got else np.zeros((0, c.shape[1]))
            near = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :probes]
            rows = [(i, int(cell), x.tobytes()) for (i, _), cells, x in zip(got, near, v) if not np.isnan(x).any() for cell in cells]
            ids, cells, units = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cells, pa.int32()), pa.array(units, pa.binary())], ["query_id", "cell", "unit"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The codes of one cell in a batch, as one row."""
        for batch in batches:
            cells = batch["cell"].to_numpy()
            for cell in np.unique(cells):
                part = batch.filter(pa.array(cells == cell))
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([part["vec_id"].to_numpy().tobytes()], pa.binary()), pa.array([b"".join(part["code"].to_pylist())], pa.binary())], ["cell", "ids", "codes"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of a cell (packed) and rows of it (packed): the best by code."""
        c, scale = put.value
        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(b"".join(row["units"])).reshape(len(row["asked"]), -1)
                ids = np.frombuffer(row["ids"], np.int64)
                v = c[row["cell"]] + np.frombuffer(row["codes"], np.int8).reshape(len(ids), -1) * scale
                s = q @ _unit(v).T
                n = min(many, len(ids))
                best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(row["asked"], np.int64), n)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(s, best, axis=1).ravel())], ["query_id", "vec_id", "near"])

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "q").mapInArrow(route, "query_id long, cell int, unit binary")
    size = max(1, -(-queries.count() // QUERIES))
    groups = asked.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(size)).alias("portion")).agg(F.sort_array(F.collect_list(F.struct("query_id", "unit"))).alias("g"))
    groups = groups.select("cell", F.transform("g", lambda x: x["query_id"]).alias("asked"), F.transform("g", lambda x: x["unit"]).alias("units"))
    rows = index.table if where is None else index.table.filter(where)
    cells = rows.select("vec_id", "cell", "code").mapInArrow(packed, "cell int, ids binary, codes binary")
    near = cells.join(groups, "cell").mapInArrow(score, "query_id long, vec_id long, near double")
    at = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    near = near.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= many).select("query_id", "vec_id")
    exact = near.join(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "vec_id").join(queries.select(F.col("query_id").cast("long").alias("query_id"), "q"), "query_id")
    exact = exact.select("query_id", "vec_id", cosine(F.col("embedding"), F.col("q")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
