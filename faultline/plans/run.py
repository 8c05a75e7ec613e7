"""The batch run: source tables to findings, published as one snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import classify, text
from ..operators import features, grouping, insight, normalize, pairs, registers, reviews, scoring, sparse
from ..sources import tables
from ..sources.store import materialise


def canonical_orders(sources: dict[str, DataFrame], as_of: str, seen: normalize.Counters | None = None) -> dict[str, DataFrame]:
    """Normalised tables of a source: orders (nested, classified, with context), links, comments.

    ``seen`` counts source and accepted rows in the passes that write them.
    """
    seen, every = seen or normalize.Counters(), F.lit(True)
    # what comes in is written once and counted as it is: later steps read it more than once
    sources = {n: materialise(seen.watch(df, n, source=every), n) for n, df in sources.items()}
    work = normalize.normalize_work_orders(sources["work_orders"], as_of)
    links = normalize.drop_catch_all(normalize.link_candidates(sources["entities"]))
    work = materialise(work, "work")
    links = materialise(normalize.with_known(links, work), "links")
    comments = materialise(normalize.with_known(normalize.normalize_comments(sources["comments"]), work), "comments")
    orders = materialise(normalize.nest(work, links, comments).withColumn("note", F.array_join("redacted_notes", " ")), "nested")
    found = materialise(classify.classify(orders, "work_order_id", "note").withColumnRenamed("key", "work_order_id"), "families")
    orders = orders.join(found, "work_order_id").withColumn("follow_up", text.has_term(F.col("note"), K.FOLLOW_UP_TERMS))
    by_asset = orders.select("work_order_id", "occurred_at", "family", "follow_up", F.explode("primary_asset_keys").alias("asset_key"))
    context = features.propagate_context(by_asset).filter("method IS NOT NULL").select("work_order_id", F.col("family").alias("_f"), F.col("trigger").alias("_t"), F.col("score").alias("_s")).dropDuplicates(["work_order_id"])
    orders = orders.join(context, "work_order_id", "left")
    hit = F.col("_f").isNotNull()
    orders = orders.withColumn("family", F.coalesce("_f", "family")).withColumn("method", F.when(hit, "sequence_context").otherwise(F.col("method"))).withColumn("trigger", F.coalesce("_t", "trigger")).withColumn("score", F.coalesce("_s", "score")).drop("_f", "_t", "_s")
    said = F.array_join("cleaned_notes", " ")
    orders = orders.withColumn("signal", F.when(F.size("cleaned_notes") > 0, text.resolution_signal(F.element_at("cleaned_notes", -1)))).withColumn("repair", text.has_term(said, K.REPAIR_TERMS))
    return {"orders": materialise(seen.watch(orders, "orders", accepted=every, eligible=F.col("eligible")), "orders"), "links": links, "comments": comments}


def analyse(spark: SparkSession, orders: DataFrame, threshold: float = K.EDGE_THRESHOLD) -> dict[str, DataFrame]:
    """Edges, incidents, members, confidence, risk and findings of the eligible orders."""
    ready = materialise(orders.filter("eligible"), "ready")
    found = pairs.candidate_pairs(ready)
    weights = sparse.fit(ready, "work_order_id", "note")[0]
    edges = materialise(pairs.score_edges(sparse.pair_similarity(materialise(found, "pairs"), weights), ready), "scored")
    kept = pairs.admitted(edges, threshold)
    groups = materialise(grouping.constrained_groups(kept, ready), "groups")
    incidents = materialise(grouping.build_incidents(groups, ready, digits=K.ID_DIGITS), "incidents")
    members = groups.join(incidents.select("group", "incident_id"), "group").join(ready, "work_order_id")
    members = materialise(members, "members")
    of = members.select("work_order_id", "incident_id")
    inside = kept.join(of.withColumnRenamed("work_order_id", "source"), "source").join(of.select(F.col("work_order_id").alias("target"), F.col("incident_id").alias("other")), "target").filter("incident_id = other")
    m = members.select("incident_id", "work_order_id", "occurred_at", "family", F.col("primary_asset_keys").alias("own"), (F.size("cleaned_notes") > 0).alias("noted"), F.col("score").alias("trigger_score"), "signal")
    confidence = materialise(scoring.with_level(scoring.confidence(incidents, m, inside.select("incident_id", "semantic")).withColumn("score", F.col("raw_score"))), "confidence")
    by_asset = members.select(F.explode("primary_asset_keys").alias("asset_key"), "work_order_id", "occurred_at", "family", "priority", "incident_id")
    signals = by_asset.select("asset_key", "incident_id").distinct().join(incidents.select("incident_id", "resolution_status"), "incident_id")
    risk = scoring.asset_risk(by_asset, signals)
    jobs = members.select("incident_id", "work_order_id", "occurred_at", "family", "repair", "signal", F.col("cleaned_notes").alias("cleaned"), F.col("redacted_notes").alias("redacted"), F.col("asset_keys").alias("assets"))
    findings = materialise(insight.complete(insight.generate_insights(incidents, jobs, tables.rules_table(spark)), confidence), "findings")
    normalize.require(insight.citation_violations(findings, jobs))
    return {"edges": edges, "incidents": incidents, "members": grouping.memberships(groups, incidents, ready, kept), "confidence": confidence, "risk": risk, "insights": findings, "evidence": insight.evidence_text(jobs)}


def carried(spark: SparkSession, root: str, out: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The reviews that a rerun keeps, and incidents under the families that reviewers gave them."""
    none = spark.createDataFrame([], "review_id string, incident_id string, decision string")
    if not tables.has_table(spark, root, "reviews"):
        old, incidents, insights = none, out["incidents"].limit(0), out["insights"].limit(0)
    else:
        old, incidents, insights = (tables.read_snapshot(spark, root, n) for n in ("reviews", "incidents", "insights"))
    kept = materialise(reviews.carry_reviews(old, incidents, insights, out["insights"]), "reviews")
    return {"reviews": kept, "incidents": reviews.with_edited_families(out["incidents"], out["insights"], reviews.complete_columns(old).withColumn("archived", F.lit(False)))}


def decide(spark: SparkSession, root: str, log: DataFrame) -> None:
    """Publish the reviews that a decision log changes, and incidents under the families that it gives or takes back.

    All other tables of the snapshot stay as they are. Log: as in ``reviews.changed_by``; free text is redacted.
    """
    after = tables.current(spark, root)[0]
    old, incidents, insights = (tables.read_snapshot(spark, root, n) for n in ("reviews", "incidents", "insights"))
    new = materialise(registers.store_decisions(reviews.apply_decisions(old, log)), "reviews")
    tables.publish_snapshot(spark, root, {"reviews": new, "incidents": reviews.with_edited_families(incidents, insights, new)}, tables.current_run(spark, root), after, keep=True)


def run(spark: SparkSession, source: str, root: str, as_of: str) -> str:
    """Read, normalise, analyse and publish as one unit, with reviews and run history carried over; the run's id.

    A failure, or another run that publishes first, leaves the published snapshot as it was.
    """
    after = tables.current(spark, root)[0]
    sources = tables.read_sources(spark, source)
    tables.gate_import(sources)
    seen = normalize.Counters()
    canonical = canonical_orders(sources, as_of, seen)
    out = canonical | analyse(spark, canonical["orders"])
    out |= carried(spark, root, out)
    run_id = uuid.uuid4().hex
    n = seen.counts()
    accepted = n["orders", "accepted"]
    counts = spark.createDataFrame([(accepted, n["work_orders", "source"] - accepted)], "accepted long, rejected long")
    history = tables.run_row(counts, run_id, source, as_of)
    if tables.has_table(spark, root, "run_history"):
        history = tables.read_snapshot(spark, root, "run_history").unionByName(history)
    return tables.publish_snapshot(spark, root, out | {"run_history": history.coalesce(1), "validation": seen.report(spark)}, run_id, after)
