"""Findings derived from rules, and the gate on their citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions import values as V


def _jobs(members: DataFrame) -> DataFrame:
    """Members of each incident as one array in time order. A job's row: t, id, family, repair, signal, cleaned, redacted, assets."""
    row = F.struct(F.col("occurred_at").alias("t"), F.col("work_order_id").alias("id"), "family", "repair", "signal", "cleaned", "redacted", "assets")
    return members.groupBy("incident_id").agg(F.array_sort(F.collect_list(row)).alias("jobs"))


def _ids(jobs: Column) -> Column:
    return F.array_join(F.transform(jobs, lambda j: j["id"]), ", ")


def _text(c: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(18,3)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _gaps(jobs: Column) -> Column:
    return F.transform(F.sequence(F.lit(2), F.size(jobs)), lambda i: F.bround(V.day_span(F.element_at(jobs, i)["t"], F.element_at(jobs, i - 1)["t"]), 3))


def pm_interval(df: DataFrame) -> DataFrame:
    """Adds ``interval``: status, days, observed gaps, supporting jobs, reason for abstaining. Needs jobs, family, recurring."""
    same = F.filter("jobs", lambda j: j["family"] == F.col("family"))
    x = df.withColumn("_same", same).withColumn("_gaps", F.when(F.size("_same") >= 2, _gaps(F.col("_same"))).otherwise(F.array().cast("array<double>")))
    x = x.withColumn("_pos", F.array_sort(F.filter("_gaps", lambda g: g > 0)))
    n = F.size("_pos")
    mid = (F.element_at("_pos", F.floor((n + 1) / 2).cast("int")) + F.element_at("_pos", F.floor(n / 2).cast("int") + 1)) / 2
    why = (
        F.when(~F.col("recurring"), K.ABSTAIN_NOT_RECURRING)
        .when(F.size("_same") < 3, F.concat(F.lit(K.ABSTAIN_FEW_JOBS[0]), F.col("family"), F.lit(K.ABSTAIN_FEW_JOBS[1])))
        .when(n < 2, K.ABSTAIN_FEW_GAPS)
    )
    few = ~F.col("recurring") | (F.size("_same") < 3)
    out = F.struct(
        F.when(why.isNull(), "RECOMMENDED").otherwise("INSUFFICIENT_EVIDENCE").alias("status"),
        F.when(why.isNull(), F.bround(mid, 1)).alias("interval_days"),
        F.when(few, F.array().cast("array<double>")).otherwise(F.col("_gaps")).alias("observed_gap_days"),
        F.transform(F.when(few, F.col("jobs")).otherwise(F.col("_same")), lambda j: j["id"]).alias("supporting_work_orders"),
        why.alias("abstention_reason"),
    )
    return x.withColumn("interval", out).drop("_same", "_gaps", "_pos")


def observations(jobs: Column, asset: Column, family: Column, recurring: Column, status: Column) -> Column:
    first, last = F.element_at(jobs, 1), F.element_at(jobs, -1)
    same, fixed = F.filter(jobs, lambda j: j["family"] == family), F.filter(jobs, lambda j: j["repair"])
    size = lambda a: F.size(a).cast("string")
    return F.array_compact(
        F.array(
            F.concat(size(jobs), F.lit(" work order(s) are linked to "), asset, F.lit(" across "), V.floor_days(last["t"], first["t"]).cast("string"), F.lit(" days (WorkOrderIds: "), _ids(jobs), F.lit(").")),
            F.when(recurring, F.concat(F.lit("The "), F.translate(family, "_", " "), F.lit(" issue appears in at least three linked work orders (WorkOrderIds: "), _ids(same), F.lit(")."))),
            F.when(recurring, F.concat(F.lit("Observed recurrence gaps are "), F.array_join(F.transform(_gaps(jobs), _text), ", "), F.lit(" days (WorkOrderIds: "), _ids(jobs), F.lit(")."))),
            F.when(F.size(fixed) > 0, F.concat(F.lit("Technician evidence records "), size(fixed), F.lit(" maintenance intervention(s) (WorkOrderIds: "), _ids(fixed), F.lit(")."))),
            F.concat(F.lit("Latest directly measurable resolution signal: "), status, F.lit(" (WorkOrderId: "), last["id"], F.lit(").")),
        )
    )


def possible_cause(jobs: Column, recurring: Column, family: Column, rule_cause: Column) -> Column:
    """Struct of statement, support_level and evidence: the first stated cause, else the rule's, else none."""
    stated = F.filter(F.transform(jobs, lambda j: F.struct(X.direct_cause(j["redacted"]).alias("s"), j["id"].alias("id"))), lambda c: c["s"].isNotNull())
    hit = F.try_element_at(stated, F.lit(1))
    none = F.array().cast("array<string>")
    ids = F.transform(jobs, lambda j: j["id"])
    row = lambda s, level, e: F.struct(s.alias("statement"), F.lit(level).alias("support_level"), e.alias("evidence"))
    return (
        F.when(hit.isNotNull(), row(F.concat(hit["s"], F.lit(" (WorkOrderId: "), hit["id"], F.lit(")")), "SUPPORTED", F.array(hit["id"])))
        .when(recurring & (family != K.UNKNOWN), row(F.concat(rule_cause, F.lit(" (Inference from WorkOrderIds: "), _ids(jobs), F.lit(".)")), "POSSIBLE", ids))
        .otherwise(row(F.lit(K.NO_CAUSE), "UNKNOWN", none))
    )


def contradicting(jobs: Column) -> Column:
    """Jobs whose notes contradict a defect, or say that it persists."""

    def against(j: Column) -> Column:
        low = F.lower(F.array_join(j["cleaned"], " "))
        said = F.lit(False)
        for p in K.CONTRADICTIONS:
            said = said | F.contains(low, F.lit(p))
        return said | (j["signal"] == "UNRESOLVED")

    return F.transform(F.filter(jobs, against), lambda j: j["id"])


def generate_insights(incidents: DataFrame, members: DataFrame, rules: DataFrame) -> DataFrame:
    """One finding for each incident, with the jobs behind each of its fields. ``rules`` are few and broadcast."""
    x = incidents.drop("jobs").join(_jobs(members), "incident_id")
    known = F.broadcast(rules.withColumnRenamed("family", "rule_family"))
    x = x.withColumn("rule_family", F.when(F.col("family").isin(*(r[0] for r in K.RULES)), F.col("family")).otherwise(K.UNKNOWN)).join(known, "rule_family")
    x = pm_interval(x)
    ids = F.transform("jobs", lambda j: j["id"])
    fixed = F.transform(F.filter("jobs", lambda j: j["repair"]), lambda j: j["id"])
    x = x.withColumn("cause", possible_cause(F.col("jobs"), F.col("recurring"), F.col("family"), F.col("possible_cause")))
    cite = F.concat(F.lit(" (WorkOrderIds: "), _ids(F.col("jobs")), F.lit(")."))
    bare = lambda c: F.regexp_replace(c, r"\.$", "")
    seen = F.concat(F.date_format("first_seen", "MMM dd, yyyy"), F.lit(" to "), F.date_format("last_seen", "MMM dd, yyyy"))
    return x.select(
        "incident_id", "asset_key", "family", "recurring",
        F.concat_ws(" · ", "label", "asset_key", "incident_id").alias("title"),
        F.concat(F.size("jobs").cast("string"), F.lit(" linked work orders from "), seen, cite).alias("summary"),
        observations(F.col("jobs"), F.col("asset_key"), F.col("family"), F.col("recurring"), F.col("resolution_status")).alias("observations"),
        F.concat(bare(F.when(F.col("recurring"), F.col("interpretation")).otherwise(K.NOT_RECURRING)), cite).alias("interpretation"),
        F.col("cause").alias("possible_cause"),
        F.concat(bare(F.when(F.col("recurring"), F.col("action")).otherwise(K.MONITOR)), cite).alias("recommended_action"),
        F.col("interval").alias("pm_interval_recommendation"), ids.alias("supporting_work_orders"), contradicting(F.col("jobs")).alias("contradicting_work_orders"),
        F.create_map(
            F.lit("summary"), ids, F.lit("observations"), ids, F.lit("interpretation"), ids, F.lit("possible_cause"), F.col("cause.evidence"),
            F.lit("recommended_action"), ids, F.lit("pm_interval_recommendation"), F.col("interval.supporting_work_orders"),
        ).alias("evidence_by_field"),
        F.struct(
            F.concat(F.lit("issues."), F.col("family")).alias("rule_id"), "resolution_status", fixed.alias("intervention_evidence"),
            F.array_sort(F.array_distinct(F.flatten(F.transform("jobs", lambda j: X.note_patterns(F.array_join(j["cleaned"], " ")))))).alias("note_patterns"),
        ).alias("provenance"),
    )


def complete(insights: DataFrame, confidence: DataFrame) -> DataFrame:
    """Findings with their confidence; citations of a field outside the finding's own jobs are taken out."""
    kept = F.transform_values("evidence_by_field", lambda _, ids: F.array_intersect(ids, F.col("supporting_work_orders")))
    return insights.withColumn("evidence_by_field", kept).join(confidence.select("incident_id", "score", "level", "needs_review"), "incident_id")


def evidence_text(members: DataFrame) -> DataFrame:
    """(incident_id, evidence): a block for each job in time order, with notes redacted for outside use."""
    note = X.redact_external(F.array_join("redacted", " | "))["text"]
    w = Window.partitionBy("incident_id").orderBy("occurred_at", "work_order_id")
    gap = F.bround(V.day_span(F.col("occurred_at"), F.lag("occurred_at").over(w)), 3)
    block = F.concat(
        F.lit("WORK ORDER: "), F.col("work_order_id"), F.lit("\nDATE: "), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ssXXX"),
        F.lit("\nDAYS SINCE PREVIOUS: "), F.coalesce(gap.cast("string"), F.lit("N/A")), F.lit("\nASSET: "), F.array_join("assets", ", "),
        F.lit("\nISSUE FAMILY: "), F.col("family"), F.lit("\nRESOLUTION SIGNAL: "), F.col("signal"),
        F.lit("\nTECHNICIAN NOTE: "), F.when(note == "", "No usable technician note.").otherwise(note),
    )
    x = members.withColumn("_b", block)
    return x.groupBy("incident_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("occurred_at", "work_order_id", "_b"))), lambda r: r["_b"]), "\n\n").alias("evidence"))


def citation_violations(insights: DataFrame, members: DataFrame) -> DataFrame:
    """(incident_id, failed): the gate every finding has to pass."""
    own = members.groupBy("incident_id").agg(F.collect_set("work_order_id").alias("_own"))
    x = insights.join(own, "incident_id", "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<string>")))
    cited = F.array_union(F.array_union("supporting_work_orders", "contradicting_work_orders"), F.col("pm_interval_recommendation.supporting_work_orders"))
    x = x.withColumn("_cited", cited)
    texts = {"observations": F.array_join("observations", " "), "possible_cause": F.col("possible_cause.statement"), "pm_interval_recommendation": F.lit("")}
    failed = [
        F.when(F.size(F.array_except("_cited", "_own")) > 0, F.lit("cited_outside_evidence")),
        F.when(F.size(F.array_except(F.map_keys("evidence_by_field"), F.array(*map(F.lit, K.CLAIM_FIELDS)))) > 0, F.lit("unknown_field")),
    ]
    for field in K.CLAIM_FIELDS:
        ids = F.coalesce(F.col("evidence_by_field")[field], F.array().cast("array<string>"))
        said = F.array_join(F.regexp_extract_all(texts.get(field, F.col(field) if field in insights.columns else F.lit("")), F.lit(K.CITATION), F.lit(1)), " ")
        named = F.array_intersect("_cited", F.split(F.trim(said), r"[^\w-]+"))
        failed += [
            F.when(F.size(F.array_except(ids, "_own")) > 0, F.lit(f"{field}_outside_evidence")),
            F.when(F.size(F.array_except(ids, "_cited")) > 0, F.lit(f"{field}_not_cited")),
            F.when(F.size(F.array_except(named, ids)) > 0, F.lit(f"{field}_unmapped")),
        ]
        if field != "pm_interval_recommendation":
            need = (F.col("possible_cause.support_level") != "UNKNOWN") if field == "possible_cause" else F.lit(True)
            failed.append(F.when(need & (F.size(named) == 0), F.lit(f"{field}_without_citation")))
    return x.select("incident_id", F.array_compact(F.array(*failed)).alias("failed")).filter(F.size("failed") > 0)


def retrieval_context(hits: DataFrame, by: str = "query_id", label: str = "label", text: str = "text", score: str = "score", k: int = 10) -> DataFrame:
    """(``by``, context): each query's ``k`` best hits, one line each, redacted for outside use; hits still unsafe are held back.

    Hits are ranked before any text is gathered, so a row holds ``k`` lines at most. Equal scores go by label and text.
    """
    x = hits.withColumn("_t", X.redact_external(F.col(text))["text"]).filter(~X.unsafe_outside(F.col("_t"), F.array().cast("array<string>")))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), label, "_t"))).filter(F.col("_n") <= k)
    line = F.concat(F.lit("["), F.col(label), F.lit("] "), F.col("_t"))
    return x.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("t")))), lambda r: r["t"]), "\n").alias("context"))
