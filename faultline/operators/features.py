"""Sequence context and temporal features of jobs on an asset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import values as V
from . import segments as S

DAY = 86_400_000_000


def nearest_known(rows: DataFrame, days: float = 180, slice_days: float = S.SLICE_DAYS) -> DataFrame:
    """For every unknown row, the nearest-in-time known row of its asset within ``days``.

    ``rows``: asset_key, work_order_id, occurred_at, family. Two scans carry the last known row before and the first
    after; the closer wins, the earlier on ties. Only rows known from the start are donors.
    """
    known = F.when(F.col("family") != K.UNKNOWN, F.struct(F.col("occurred_at").alias("t"), F.col("work_order_id").alias("id"), F.col("family").alias("f")))
    at_row = (["asset_key"], "occurred_at", "work_order_id")
    x = S.first_after(S.last_before(S.sliced(rows, "occurred_at", slice_days), *at_row, known, "_b"), *at_row, known, "_a").filter(F.col("family") == K.UNKNOWN)
    at = V.micros(F.col("occurred_at"))
    back, ahead = at - V.micros(F.col("_b.t")), V.micros(F.col("_a.t")) - at
    d = F.when(ahead.isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_a"))
    gap = F.least(F.coalesce(back, ahead), F.coalesce(ahead, back))
    return x.withColumn("_d", d).withColumn("gap_us", gap).filter(F.col("gap_us") <= int(days * DAY)).select("asset_key", "work_order_id", F.col("_d.id").alias("donor"), F.col("_d.f").alias("donor_family"), "gap_us")


def propagate_context(rows: DataFrame, days: float = 180) -> DataFrame:
    """``rows`` with family, method and score after follow-ups took over a neighbour's family. Needs follow_up.

    A job on several assets takes the nearest donor of all of them.
    """
    found = nearest_known(rows.select("asset_key", "work_order_id", "occurred_at", "family", "follow_up"), days)
    best = found.join(rows.filter("follow_up").select("work_order_id").distinct(), "work_order_id", "left_semi").groupBy("work_order_id").agg(F.min_by(F.struct("donor", "donor_family"), F.struct("gap_us", "donor")).alias("_d"))
    x = rows.join(best, "work_order_id", "left")
    hit = (F.col("family") == K.UNKNOWN) & F.col("_d").isNotNull()
    return x.withColumn("method", F.when(hit, "sequence_context")).withColumn("trigger", F.when(hit, F.concat(F.lit("follow-up to "), F.col("_d.donor")))).withColumn("score", F.when(hit, 0.70)).withColumn("family", F.when(hit, F.col("_d.donor_family")).otherwise(F.col("family"))).drop("_d")


def temporal_features(rows: DataFrame, days=(30, 90, 365), slice_days: float = S.SLICE_DAYS) -> DataFrame:
    """Per (asset, job): floor days since the previous, prior jobs within each number of days, and same-family history.

    ``rows``: asset_key, work_order_id, occurred_at, family, repair; a job is on an asset once. Rows of equal time are
    ordered by id. Prior jobs within d days are the jobs before the row less those before d days ago, which probes at
    that time count on the same scan.
    """
    at_row = ("occurred_at", "work_order_id")
    x = S.sliced(rows, "occurred_at", slice_days)
    x = S.last_before(x, ["asset_key"], *at_row, F.col("occurred_at"), "_p")
    x = x.withColumn("days_since_previous", V.floor_days(F.col("occurred_at"), F.col("_p")))
    both = ["asset_key", "family"]
    x = S.last_before(x, both, *at_row, F.col("occurred_at"), "_q").withColumn("_gap", V.floor_days(F.col("occurred_at"), F.col("_q")))
    x = S.sums_before(x, both, *at_row, _seen=F.lit(1), _gaps=F.col("_gap"), _gapped=F.col("_gap").isNotNull().cast("long"), previous_repairs=F.col("repair").cast("long"))
    x = x.withColumn("recurrence_interval_days", F.try_divide(F.col("_gaps"), F.col("_gapped"))).withColumn("persistence", F.least(F.lit(1.0), F.col("_seen") / 4.0)).drop("_slice", "_p", "_q", "_gap", "_seen", "_gaps", "_gapped")
    t = V.micros(F.col("occurred_at"))
    real = rows.select("asset_key", "work_order_id", t.alias("_t"), F.lit(1).alias("_real"), F.lit(-1).alias("_d"))
    probes = rows.select("asset_key", "work_order_id", t.alias("_t"), F.explode(F.array(*map(F.lit, days))).alias("_d")).select("asset_key", "work_order_id", (F.col("_t") - F.col("_d").cast("long") * DAY).alias("_t"), F.lit(0).alias("_real"), "_d")
    # a probe stands before all jobs of its time
    y = real.unionByName(probes).withColumn("_tie", F.struct("_real", "work_order_id", "_d")).withColumn("_at", F.timestamp_micros("_t"))
    y = S.sums_before(S.sliced(y, "_at", slice_days), ["asset_key"], "_at", "_tie", _before=F.col("_real"))
    counts = y.groupBy("asset_key", "work_order_id").agg(F.max(F.when(F.col("_d") == -1, F.col("_before"))).alias("_r"), *(F.max(F.when(F.col("_d") == d, F.col("_before"))).alias(f"_b{d}") for d in days))
    within = counts.select("asset_key", "work_order_id", *((F.col("_r") - F.col(f"_b{d}")).alias(f"jobs_{d}d") for d in days))
    return x.join(within, ["asset_key", "work_order_id"])


def family_distribution(rows: DataFrame, family: str = "family") -> DataFrame:
    return rows.groupBy(family).agg(F.count("*").alias("n"))
