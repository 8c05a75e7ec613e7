"""A review table in buckets of its key, of which a merge rewrites only those it touches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import commit, current


class ReviewStore:
    """Generations of a table keyed by ``key``: each names a folder for every bucket that has rows.

    A merge writes the touched buckets under a new folder and then claims the next generation. If another writer was
    faster it fails, and nothing that it wrote is ever read. Earlier generations stay readable.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, key: str = "review_id"):
        self.spark, self.root, self.buckets, self.key = spark, root, buckets, key

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def state(self) -> tuple[int, dict]:
        """(generation, what it holds: schema and folders by bucket)."""
        number, content = current(self.spark, self.root)
        return number, json.loads(content) if content else {"schema": None, "buckets": {}}

    def _frame(self, state: dict, only: set[int] | None = None) -> DataFrame | None:
        paths = [p for b, p in sorted(state["buckets"].items()) if only is None or int(b) in only]
        if state["schema"] is None:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(state["schema"]))
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._frame(self.state()[1])

    def merge(self, changed: DataFrame, gone: DataFrame | None = None, after: int | None = None) -> set[int]:
        """Put the rows of ``changed`` in place of those of their keys, take the keys of ``gone`` out; the buckets rewritten.

        ``after``: the generation that ``changed`` was derived from (default: the current one); if it's no longer the
        current one, the merge fails.
        """
        number, state = self.state()
        after = number if after is None else after
        if after != number:
            raise RuntimeError(f"{self.root} is at generation {number}, not {after}")
        keys = changed.select(self.key) if gone is None else changed.select(self.key).union(gone.select(self.key))
        touched = {r.b for r in keys.select(self._bucket().alias("b")).distinct().collect()}  # as many as there are buckets
        old = self._frame(state, touched)
        rows = changed if old is None else old.join(keys.distinct(), self.key, "left_anti").select(*changed.columns).unionByName(changed)
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).repartition(F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        held = {r.b for r in self.spark.read.parquet(f"{self.root}/{folder}").select(F.col("bucket").alias("b")).distinct().collect()} if touched else set()
        buckets = {b: p for b, p in state["buckets"].items() if int(b) not in touched} | {str(b): f"{folder}/bucket={b}" for b in held}
        commit(self.spark, self.root, after, json.dumps({"schema": changed.schema.json(), "buckets": buckets}))
        return touched
