"""Reviews of findings: decisions, family edits that reach incidents, and what a rerun keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEPT = ("review_id", "incident_id", "decision", "edited_family", "edited_action", "reviewer_note", "decided_at", "archived", "snapshot")
_TEXT = ("edited_family", "edited_action", "reviewer_note")


def complete_columns(reviews: DataFrame) -> DataFrame:
    """Reviews with every column of ``KEPT``; those of older tables are null, not archived, without a snapshot."""
    other = {**dict.fromkeys(_TEXT, F.lit(None).cast("string")), "decided_at": F.lit(None).cast("timestamp"), "archived": F.lit(False), "snapshot": F.lit("{}")}
    return reviews.select(*(c if c in reviews.columns else other[c].alias(c) for c in KEPT))


def latest_decisions(log: DataFrame) -> DataFrame:
    """The last entry of a decision log for each review; entries of one time go by decision, then family."""
    at = Window.partitionBy("review_id").orderBy(F.desc("decided_at"), F.desc("decision"), F.desc_nulls_last("edited_family"))
    return log.withColumn("_n", F.row_number().over(at)).filter("_n = 1").drop("_n")


def changed_by(reviews: DataFrame, log: DataFrame) -> DataFrame:
    """The reviews that a log changes, as they are afterwards. Archived ones are read-only; unknown ones don't count.

    Log: review_id, decision, decided_at, edited_family, and sets_family: whether the entry says anything about the
    family. A null family that is set takes an edit back.
    """
    new = latest_decisions(log).select("review_id", F.col("decision").alias("_d"), F.col("edited_family").alias("_f"), F.col("sets_family").alias("_s"), F.col("decided_at").alias("_t"))
    x = complete_columns(reviews).filter("NOT archived").join(new, "review_id")
    x = x.withColumn("edited_family", F.when(F.col("_s"), F.col("_f")).otherwise(F.col("edited_family")))
    return x.withColumn("decision", F.col("_d")).withColumn("decided_at", F.col("_t")).select(*KEPT)


def apply_decisions(reviews: DataFrame, log: DataFrame) -> DataFrame:
    """All reviews with their latest decisions."""
    changed = changed_by(reviews, log)
    return complete_columns(reviews).join(changed.select("review_id"), "review_id", "left_anti").select(*KEPT).unionByName(changed)


def with_edited_families(incidents: DataFrame, insights: DataFrame, reviews: DataFrame) -> DataFrame:
    """Incidents under the family that a review gave them, the finding's own where an edit was taken back or never made."""
    own = insights.select("incident_id", F.col("family").alias("_own"))
    edited = reviews.filter("NOT archived").select("incident_id", F.col("edited_family").alias("_edit"))
    x = incidents.join(own, "incident_id", "left").join(edited, "incident_id", "left")
    return x.withColumn("family", F.coalesce("_edit", "_own", "family")).drop("_own", "_edit")


def snapshots(incidents: DataFrame, insights: DataFrame) -> DataFrame:
    """(incident_id, _snap): an incident and its finding with all their columns, as JSON."""
    i = incidents.select("incident_id", F.struct(*incidents.columns).alias("incident"))
    f = insights.select("incident_id", F.struct(*insights.columns).alias("insight"))
    return i.join(f, "incident_id").select("incident_id", F.to_json(F.struct("incident", "insight")).alias("_snap"))


def carry_reviews(old: DataFrame, old_incidents: DataFrame, old_insights: DataFrame, insights: DataFrame) -> DataFrame:
    """Reviews after a rerun.

    Of findings that are still there, decided reviews stay as they are, and a finding that needs a review has one,
    pending unless it was decided; pending ones of findings that no longer need one go. Of findings that are gone every
    review is kept, pending or not, archived with the snapshot it had or, if it had none, with one of the old incident
    and finding (an empty one if they are missing). A review that was archived and whose finding is back is open again.
    """
    o = complete_columns(old).withColumn("_had", F.lit(True))
    x = o.join(insights.select("incident_id", "needs_review", F.lit(True).alias("_is")), "incident_id", "full_outer")
    here, had = F.col("_is").isNotNull(), F.col("_had").isNotNull()
    stays = ~here | F.coalesce("needs_review", F.lit(False)) | (had & (F.col("decision") != "pending"))
    x = x.filter(stays).join(snapshots(old_incidents, old_insights), "incident_id", "left")
    kept = F.when((F.col("snapshot") != "{}") & (F.col("snapshot") != ""), F.col("snapshot"))
    x = x.withColumn("snapshot", F.when(here, "{}").otherwise(F.coalesce(kept, "_snap", F.lit("{}")))).withColumn("archived", ~here)
    return x.withColumn("review_id", F.coalesce("review_id", F.concat(F.lit("R-"), "incident_id"))).withColumn("decision", F.coalesce("decision", F.lit("pending"))).select(*KEPT)
