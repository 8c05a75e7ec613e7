"""Calibration of scores against labels, and the audit sample."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import materialise
from .segments import least_hashes

ARTIFACT = T.StructType([T.StructField("x_values", T.ArrayType(T.DoubleType())), T.StructField("y_values", T.ArrayType(T.DoubleType())), T.StructField("score_space", T.StringType()), T.StructField("provenance", T.StringType()), T.StructField("dataset_id", T.StringType())])


def check_labels(rows: DataFrame) -> None:
    """``rows``: score in [0, 1], label 0 or 1."""
    if not rows.filter(~F.coalesce(F.col("score").between(0, 1) & F.col("label").isin(0, 1), F.lit(False))).isEmpty():
        raise ValueError("scores must lie in [0, 1] and labels be 0 or 1")


POOL = "part long, x double, total double, n double"


def _pooled(x: list[float], total: list[float], n: list[float]) -> list[list[float]]:
    """Blocks (x, total, n) in ascending x, merged until their means rise."""
    out: list[list[float]] = []
    for row in zip(x, total, n):
        out.append(list(row))
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            _, t, m = out.pop()
            out[-1][1] += t
            out[-1][2] += m
    return out


def _merge(part: int, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("x")
    blocks = _pooled(*(rows[c].to_pylist() for c in ("x", "total", "n")))
    x, total, n = zip(*blocks) if blocks else ((), (), ())
    return pa.table({"part": pa.array([part] * len(x), pa.int64()), "x": pa.array(x, pa.float64()), "total": pa.array(total, pa.float64()), "n": pa.array(n, pa.float64())})


def isotonic_blocks(rows: DataFrame, parts: int = 64, fan: int = 8) -> DataFrame:
    """(x, y) of the pool-adjacent-violators fit, one row a step: the least score of a block and its mean label.

    Scores are pooled in ranges, each by itself; then the block lists of ``fan`` neighbouring ranges are pooled again
    until one list is left, whose order of merges doesn't matter. Equal scores are pooled first.
    """
    pooled = rows.groupBy(F.col("score").alias("x")).agg(F.sum(F.col("label").cast("double")).alias("total"), F.count("*").cast("double").alias("n"))
    part = F.least(F.floor(F.col("x") * parts), F.lit(parts - 1)).cast("long")
    blocks, left = pooled.select(part.alias("part"), "x", "total", "n"), parts
    while True:
        blocks = materialise(blocks.groupBy("part").applyInArrow(lambda key, t: _merge(key[0].as_py(), t), POOL), "blocks")
        if left == 1:
            return blocks.select("x", (F.col("total") / F.col("n")).alias("y"))
        left = -(-left // fan)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / fan).cast("long"))


def fit_isotonic(rows: DataFrame, provenance: str = "human", dataset_id: str | None = None) -> DataFrame:
    """One artifact row: the steps of the pool-adjacent-violators fit, in two arrays."""
    s = F.array_sort(F.collect_list(F.struct("x", "y")))
    x = isotonic_blocks(rows).agg(s.alias("s"))
    return x.select(F.transform("s", lambda p: p["x"]).alias("x_values"), F.transform("s", lambda p: p["y"]).alias("y_values"), F.lit("raw").alias("score_space"), F.lit(provenance).alias("provenance"), F.lit(dataset_id).cast("string").alias("dataset_id"))


def artifact_violations(artifact: DataFrame) -> DataFrame:
    """Artifacts whose curve isn't valid: unequal lengths, out of [0, 1], unsorted or falling."""
    rising = lambda c: F.forall(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: a <= b), lambda ok: ok)
    ok = (F.size("x_values") == F.size("y_values")) & (F.size("x_values") > 0) & F.forall("x_values", lambda v: v.between(0, 1)) & F.forall("y_values", lambda v: v.between(0, 1)) & rising("x_values") & rising("y_values")
    return artifact.filter(~F.coalesce(ok, F.lit(False)))


def save_artifact(artifact: DataFrame, path: str) -> None:
    artifact.coalesce(1).write.mode("overwrite").json(path)


def load_artifact(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.schema(ARTIFACT).json(path)
    if not artifact_violations(out).isEmpty():
        raise ValueError(f"{path} doesn't hold a valid calibration curve")
    return out


def brier(rows: DataFrame) -> DataFrame:
    right = ((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("double")
    return rows.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2))).alias("brier"), F.avg(right).alias("accuracy"))


def bins(rows: DataFrame, n: int = 10) -> DataFrame:
    """Equal bins of the score, the last one closed; empty ones are left out."""
    at = F.least(F.floor(F.col("score") * n), F.lit(n - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("observed"))


def thresholds(rows: DataFrame, at=(0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """For each threshold: accepted rows, their precision, rows left for review, share of rows accepted."""
    t = rows.sparkSession.createDataFrame([(float(x),) for x in at], "threshold double")
    ok = F.col("score") >= F.col("threshold")
    x = rows.crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.count_if(ok).alias("accepted"), F.avg(F.when(ok, F.col("label").cast("double"))).alias("precision"), F.count_if(~ok).alias("review_load"), F.count("*").alias("n"))
    return x.select("threshold", "accepted", "precision", "review_load", (F.col("accepted") / F.col("n")).alias("coverage"))


def split_by_asset(rows: DataFrame, fraction: float = 0.2, asset: str = "asset_key") -> DataFrame:
    """``rows`` with held_out: all rows of the first max(1, round(n * fraction)) assets by SHA-256."""
    hashed = materialise(rows.select(asset).distinct().filter(F.col(asset).isNotNull()).select(asset, F.sha2(F.col(asset), 256).alias("_h"), F.lit(0).alias("_all")), "assets")
    want = hashed.groupBy("_all").agg(F.greatest(F.lit(1), F.round(F.count("*") * fraction)).cast("long").alias("k"))
    bound = F.broadcast(least_hashes(hashed, "_all", "_h", want).select("bound"))  # one row
    x = rows.crossJoin(bound) if not hashed.isEmpty() else rows.withColumn("bound", F.lit(None).cast("string"))
    return x.withColumn("held_out", F.coalesce(F.sha2(F.col(asset), 256) <= F.col("bound"), F.lit(False))).drop("bound")


def audit_sample(incidents: DataFrame, size: int = 50, seed: str = "audit", key: str = "incident_id") -> DataFrame:
    """A fixed sample: the ``size`` least hashes of seed and id."""
    return incidents.withColumn("_h", F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")), 256)).orderBy("_h", key).limit(size).drop("_h")


COMPONENTS = ("membership_correct", "family_correct", "cause_correct", "action_correct", "citations_correct")


def write_audit(sample: DataFrame, path: str) -> None:
    """A sample as CSV for people to label: a blank column for each label that it doesn't carry."""
    blank = [F.lit(None).cast("string").alias(c) for c in (*COMPONENTS, "actual_correct") if c not in sample.columns]
    sample.select("*", *blank).coalesce(1).write.csv(path, header=True, escape='"')  # a sample is small


def read_audit(spark: SparkSession, path: str, key: str = "incident_id") -> DataFrame:
    """A labelled CSV: raw_score as a number and the labels as integers; rows that no one has labelled are left out."""
    x = spark.read.csv(path, header=True, escape='"', multiLine=True)
    missing = {key, "raw_score", *COMPONENTS, "actual_correct"} - set(x.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    x = x.withColumn("raw_score", F.col("raw_score").try_cast("double"))
    for c in (*COMPONENTS, "actual_correct"):
        x = x.withColumn(c, F.trim(c).try_cast("int"))
    return x.filter(F.coalesce(*COMPONENTS, "actual_correct").isNotNull())


def label_violations(rows: DataFrame) -> DataFrame:
    """Audit rows whose component labels aren't all 0 or 1, or don't multiply to actual_correct."""
    ok = F.lit(True)
    every = F.lit(1)
    for c in COMPONENTS:
        ok = ok & F.coalesce(F.col(c).isin(0, 1), F.lit(False))
        every = every * F.col(c)
    return rows.filter(~(ok & F.coalesce(F.col("actual_correct") == every, F.lit(False))))


def declared(rows: DataFrame, column: str) -> DataFrame:
    """The one value that non-blank rows of a column declare, and how many different ones there are."""
    x = F.when(F.trim(F.coalesce(column, F.lit(""))) != "", F.trim(column))
    return rows.agg(F.min(x).alias("value"), F.count_distinct(x).alias("declared"))


def label_contract(findings: DataFrame, expected: DataFrame, banned=("guaranteed", "definitely")) -> DataFrame:
    """Labels findings against a manifest and names the first failure.

    ``findings``: incident_id, asset_key, members, family, cited, field_ids, text. ``expected``: asset_key,
    want_members, want_family.
    """
    x = findings.join(expected, "asset_key", "left")
    empty = lambda a, b: F.size(F.array_except(a, b)) == 0
    bad = F.lit(False)
    for p in banned:
        bad = bad | F.contains(F.lower("text"), F.lit(p))
    checks = (
        ("membership", F.array_sort("members") == F.array_sort("want_members")),
        ("family", F.col("family") == F.col("want_family")),
        ("citations", empty(F.col("cited"), F.col("members"))),
        ("field_ids", empty(F.col("field_ids"), F.col("cited"))),
        ("markers", F.contains("text", F.lit("WorkOrderId"))),
        ("wording", ~bad),
    )
    failure = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks))
    return x.select("incident_id", failure.alias("failure"), failure.isNull().cast("int").alias("actual_correct"))
