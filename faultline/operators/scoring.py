"""Confidence of incidents and risk of assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import values as V


def confidence(incidents: DataFrame, members: DataFrame, edges: DataFrame, weights=K.CONFIDENCE_WEIGHTS) -> DataFrame:
    """Components and raw score of each incident.

    ``incidents``: incident_id, asset_key, family. ``members``: incident_id, work_order_id, occurred_at, family, own
    (anchors), noted, trigger_score, signal. ``edges``: incident_id, semantic.
    """
    m = members.join(incidents.select("incident_id", F.col("asset_key").alias("i_asset"), F.col("family").alias("i_family")), "incident_id")
    gap = V.floor_days(F.col("occurred_at"), F.lag("occurred_at").over(Window.partitionBy("incident_id").orderBy("occurred_at", "work_order_id")))
    m = m.withColumn("gap", gap)
    per = m.groupBy("incident_id").agg(
        F.avg(F.array_contains("own", F.col("i_asset")).cast("double")).alias("asset_consistency"),
        F.coalesce(F.avg(F.greatest(F.lit(0.0), 1.0 - F.col("gap") / 180.0)), F.lit(0.5)).alias("temporal_consistency"),
        F.least(F.lit(1.0), 0.35 + F.count_if("noted") / F.greatest(F.lit(2), F.count("*")) * 0.65).alias("evidence_strength"),
        F.avg(F.when(F.col("family") == F.col("i_family"), F.coalesce("trigger_score", F.lit(1.0))).otherwise(0.0)).alias("issue_agreement"),
        F.least(F.lit(0.18), F.count_if(F.col("signal") == "UNRESOLVED") * 0.04).alias("conflict_penalty"),
    )
    sem = edges.groupBy("incident_id").agg(F.avg("semantic").alias("_s"))
    x = per.join(sem, "incident_id", "left").withColumn("semantic_consistency", F.coalesce("_s", F.lit(0.40))).drop("_s")
    raw = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) - F.col("conflict_penalty")
    return x.withColumn("raw_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def with_level(df: DataFrame, score: str = "score", review: float = K.REVIEW) -> DataFrame:
    s = F.col(score)
    return df.withColumn("level", F.when(s >= K.HIGH, "HIGH").when(s >= K.MEDIUM, "MEDIUM").otherwise("LOW")).withColumn("needs_review", s < review)


def calibrated(score: Column, x: Column, y: Column) -> Column:
    """The step function through (x, y), right-continuous; scores before the first step take its value."""
    return F.element_at(y, F.greatest(F.size(F.filter(x, lambda v: v <= score)), F.lit(1)))


def guard_calibration(artifact: dict | None, operational: bool, dataset: str | None = None) -> None:
    """Refuses artifacts that don't fit: not in raw space, missing or synthetic on operational data, of other data."""
    if artifact is None:
        if operational:
            raise ValueError("operational data needs a calibration artifact")
        return
    if artifact.get("score_space", "raw") != "raw":
        raise ValueError("the artifact must transform raw scores")
    if operational and artifact.get("provenance") == "synthetic":
        raise ValueError("a synthetic artifact can't calibrate operational data")
    if dataset is not None and artifact.get("dataset_id") not in (None, dataset):
        raise ValueError("the artifact belongs to other data")


def refusals(artifacts: DataFrame, operational: bool, dataset: str | None = None) -> DataFrame:
    """``artifacts`` with the first reason, if any, why each can't calibrate; the guard's rules as a column."""
    why = F.when(F.coalesce("score_space", F.lit("raw")) != "raw", "score_space")
    if operational:
        why = why.when(F.col("provenance") == "synthetic", "synthetic")
    if dataset is not None:
        why = why.when(F.col("dataset_id") != dataset, "dataset")
    return artifacts.withColumn("refused", why)


def risk_evidence(incidents: DataFrame, members: DataFrame, orders: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """One row an asset and job of active incidents: the job's own links, else the incident's asset.

    Without ``orders`` and ``links``, ``members`` carry occurred_at, priority and asset_key themselves.
    """
    i = incidents.select("incident_id", F.col("asset_key").alias("_asset"), "family")
    if orders is None:
        x = members.select("incident_id", "work_order_id", "occurred_at", "priority", "asset_key").join(i, "incident_id")
        x = x.select(F.coalesce("asset_key", "_asset").alias("asset_key"), "work_order_id", "occurred_at", "family", "priority")
        return x.repartition("asset_key").distinct()  # risk is counted an asset, so rows are dealt once
    m = members.select("incident_id", "work_order_id").join(i, "incident_id")
    x = m.join(orders.select("work_order_id", "occurred_at", "priority"), "work_order_id").join(links.select("work_order_id", "asset_key"), "work_order_id", "left")
    return x.select(F.coalesce("asset_key", "_asset").alias("asset_key"), "work_order_id", "occurred_at", "family", "priority").distinct()


def asset_risk(evidence: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Risk of each asset, 0 to 100.

    ``evidence``: asset_key, work_order_id, occurred_at, family, priority, one row a job and asset.
    ``signals``: asset_key, incident_id, resolution_status, one row an incident and asset. Without them every row of
    ``evidence`` is one, with a resolution_status of its own.
    """
    unresolved = F.count_if(F.col("resolution_status").isin(*K.UNRESOLVED_SIGNALS))
    last = F.max("occurred_at").over(Window.partitionBy("asset_key"))
    x = evidence.withColumn("_recent", (V.micros(F.col("occurred_at")) >= V.micros(last) - 90 * 86_400_000_000).cast("int"))
    # the largest family of an asset comes from counts per (asset, family), which also carry the other sums
    f = x.groupBy("asset_key", "family").agg(F.count("*").alias("n"), F.sum("_recent").alias("r"), F.count_if(F.lower("priority").isin(*K.HIGH_PRIORITIES)).alias("h"), (unresolved if signals is None else F.lit(0)).alias("u"))
    a = f.groupBy("asset_key").agg(F.sum("n").alias("jobs"), F.max("n").alias("repeated"), F.sum("r").alias("recent_90"), F.sum("h").alias("high_priority"), F.sum("u").alias("unresolved"))
    if signals is not None:
        a = a.drop("unresolved").join(signals.groupBy("asset_key").agg(unresolved.alias("unresolved")), "asset_key", "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(0)))
    part = lambda c, n: F.least(F.lit(1.0), F.col(c) / F.lit(float(n)))
    recurrence = F.least(F.lit(1.0), F.greatest(F.lit(0), F.col("repeated") - 1) / 4.0)
    score = 25 * part("jobs", 8) + 30 * recurrence + 15 * part("high_priority", 3) + 15 * part("unresolved", 3) + 15 * part("recent_90", 5)
    reasons = F.array_compact(
        F.array(
            F.concat(F.col("jobs").cast("string"), F.lit(" work orders in the analyzed history")),
            F.when(F.col("recent_90") > 0, F.concat(F.col("recent_90").cast("string"), F.lit(" work orders within its latest 90-day window"))),
            F.when(F.col("repeated") > 1, F.concat(F.lit("same issue family repeated "), F.col("repeated").cast("string"), F.lit(" times"))),
            F.when(F.col("high_priority") > 0, F.concat(F.col("high_priority").cast("string"), F.lit(" high-priority work orders"))),
            F.when(F.col("unresolved") > 0, F.concat(F.col("unresolved").cast("string"), F.lit(" episodes lack a confirmed resolution"))),
        )
    )
    return a.withColumn("risk", F.bround(score).cast("long")).withColumn("reasons", reasons)
