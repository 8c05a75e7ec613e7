"""Reading and publishing tables: aliases, the import gate, snapshots, run history."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.values import asset_class


def resolve_column(df: DataFrame, names: tuple[str, ...], required: bool = True) -> str | None:
    """The first of ``names`` that ``df`` has, whatever the case and underscores; raises before any job runs."""
    have = {c.lower().replace("_", ""): c for c in reversed(df.columns)}
    for n in names:
        if (c := have.get(n.lower().replace("_", ""))) is not None:
            return c
    if required:
        raise ValueError(f"no column of {names} among {df.columns}")
    return None


def with_canonical_columns(df: DataFrame, kind: str) -> DataFrame:
    """Known columns of a source table under their canonical names, as strings, with null words as null."""
    out = []
    for name, aliases in K.ALIASES[kind].items():
        c = resolve_column(df, aliases, name in K.REQUIRED[kind])
        x = F.lit(None).cast("string") if c is None else F.col(f"`{c}`").cast("string")
        out.append(F.when(~x.isin(*K.NULL_TOKENS), x).alias(name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings. Quoted line breaks make a file unsplittable: convert large files to parquet once."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def source_dir(spark: SparkSession, path: str) -> str:
    """``path`` or its ``data`` child, whichever holds all source tables."""
    for at in (path, f"{path}/data"):
        if all(any(_exists(spark, f"{at}/{f}.{x}") for x in ("csv", "parquet")) for f in K.SOURCE_FILES.values()):
            return at
    raise FileNotFoundError(f"{path} doesn't hold {', '.join(K.SOURCE_FILES.values())}")


def read_sources(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three source tables with canonical columns."""
    at, out = source_dir(spark, path), {}
    for kind, name in K.SOURCE_FILES.items():
        parquet = _exists(spark, f"{at}/{name}.parquet")
        raw = spark.read.parquet(f"{at}/{name}.parquet") if parquet else read_csv(spark, f"{at}/{name}.csv")
        out[kind] = with_canonical_columns(raw, kind)
    return out


def gate_import(sources: dict[str, DataFrame]) -> None:
    """Raises unless every table is there with its required columns and one row at least."""
    for kind in K.SOURCE_FILES:
        if kind not in sources:
            raise ValueError(f"{kind} is missing")
        for name in K.REQUIRED[kind]:
            resolve_column(sources[kind], (name, *K.ALIASES[kind][name]))
        if sources[kind].isEmpty():
            raise ValueError(f"{kind} has no rows")


# ---- generations: what is current is the file of the largest number that was created whole ----


def _listed(spark: SparkSession, folder: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def current(spark: SparkSession, root: str) -> tuple[int, str]:
    """(generation, content); (0, "") before the first one. A claim whose writer died before its last byte doesn't count."""
    for n in sorted((int(x) for x in _listed(spark, f"{root}/_GENERATIONS") if x.isdigit()), reverse=True):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_GENERATIONS/{n:012d}")
        with_end = "".join(spark.read.text(at.toString(), wholetext=True).first() or [""])
        if with_end.endswith("\n"):
            return n, with_end[:-1]
    return 0, ""


def commit(spark: SparkSession, root: str, after: int, content: str) -> int:
    """Make ``content`` the generation that follows ``after``. Of several writers one creates the file; the others fail.

    Rests on the file system's creation without overwriting, which HDFS and local disks make exclusive.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_GENERATIONS/{after + 1:012d}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if current(spark, root)[0] != after:
        raise RuntimeError(f"{root} has moved on from generation {after}")
    try:
        out = fs.create(at, False)
    except Exception as e:  # noqa: BLE001  py4j wraps what the file system throws
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            raise RuntimeError(f"another writer made generation {after + 1} of {root}") from e
        raise
    out.write(bytearray((content + "\n").encode()))
    out.close()
    return after + 1


# ---- snapshots: a folder for each run, named by a generation that is claimed last ----


def _snapshot(spark: SparkSession, root: str) -> dict:
    """What the current generation names: run, and the folder of each table."""
    content = current(spark, root)[1]
    return json.loads(content) if content else {"run": None, "tables": {}}


def publish_snapshot(spark: SparkSession, root: str, tables: dict[str, DataFrame], run_id: str | None = None, after: int | None = None, keep: bool = False) -> str:
    """Write all tables under a new run folder, then claim the next generation for it. A failure leaves the old snapshot.

    ``after``: the generation that the tables were derived from (default: the current one). A writer that another one
    has overtaken fails, and its folder is removed. With ``keep``, tables that aren't given stay as they are in the
    current snapshot, and nothing of them is written again.
    """
    run_id, after = run_id or uuid.uuid4().hex, current(spark, root)[0] if after is None else after
    old = _snapshot(spark, root)["tables"] if keep else {}
    folder = f"runs/{run_id}-{uuid.uuid4().hex[:8]}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{root}/{folder}/{name}")
        commit(spark, root, after, json.dumps({"run": run_id, "tables": old | {name: f"{folder}/{name}" for name in tables}}))
    except BaseException:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        raise
    return run_id


def current_run(spark: SparkSession, root: str) -> str | None:
    return _snapshot(spark, root)["run"]


def has_table(spark: SparkSession, root: str, name: str) -> bool:
    """Whether the current snapshot has a table of that name."""
    return name in _snapshot(spark, root)["tables"]


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current snapshot; the frame keeps to it when another one is published."""
    return spark.read.parquet(f"{root}/{_snapshot(spark, root)['tables'][name]}")


def run_row(df_of_counts: DataFrame, run_id: str, source: str, started_at: str) -> DataFrame:
    """One row of run history: who ran on what, when, and how many rows were accepted and rejected."""
    return df_of_counts.select(F.lit(run_id).alias("run_id"), F.lit(source).alias("source"), F.col("accepted").cast("long").alias("accepted"), F.col("rejected").cast("long").alias("rejected"), F.lit(started_at).cast("timestamp").alias("started_at"), F.current_timestamp().alias("completed_at"))


def append_run(df_of_counts: DataFrame, root: str, run_id: str, source: str, started_at: str) -> None:
    run_row(df_of_counts, run_id, source, started_at).coalesce(1).write.mode("append").parquet(f"{root}/_RUNS")


def latest_run(spark: SparkSession, root: str) -> DataFrame:
    """The last run of a snapshot's history, or of a history kept by itself."""
    runs = read_snapshot(spark, root, "run_history") if has_table(spark, root, "run_history") else spark.read.parquet(f"{root}/_RUNS")
    return runs.orderBy(F.desc("completed_at"), "run_id").limit(1)


def backfill(work_orders: DataFrame | None = None, comments: DataFrame | None = None, assets: DataFrame | None = None, reviews: DataFrame | None = None):
    """Tables of older snapshots with the columns added since: asset_class, source_sequence, archived, snapshot."""
    if assets is not None and "asset_class" not in assets.columns:
        assets = assets.withColumn("asset_class", asset_class(F.split_part("asset_key", F.lit(":"), F.lit(1))))
    if comments is not None and "source_sequence" not in comments.columns:
        at = F.row_number().over(Window.partitionBy("work_order_id").orderBy("created_at", "comment_id"))
        comments = comments.withColumn("source_sequence", F.coalesce(F.expr("try_cast(comment_id AS BIGINT)"), at.cast("long")))
    if reviews is not None:
        if "archived" not in reviews.columns:
            reviews = reviews.withColumn("archived", F.lit(False))
        if "snapshot" not in reviews.columns:
            reviews = reviews.withColumn("snapshot", F.lit("{}"))
    return work_orders, comments, assets, reviews


RULE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("family", "label", "interpretation", "possible_cause", "action")])


def rules_table(spark: SparkSession, rows=K.RULES) -> DataFrame:
    """The rule texts by family; eleven rows unless other rules are given."""
    return spark.createDataFrame(rows, RULE_SCHEMA)
