"""Candidate pairs of jobs and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import values as V

DAY = 86_400_000_000


def window_pairs(rows: DataFrame, by: str = "asset_key", days: float = K.PAIR_DAYS) -> DataFrame:
    """Distinct (source, target) of jobs of one asset at most ``days`` apart; ids in order.

    ``rows``: work_order_id, occurred_at, ``by``. Jobs are put in time buckets as wide as the window, so a job meets
    its own bucket and the next one only, and a long history is dealt over many (asset, bucket) keys.
    """
    width = int(days * DAY)
    x = rows.select(by, "work_order_id", V.micros(F.col("occurred_at")).alias("t")).distinct().withColumn("b", F.floor(F.col("t") / F.lit(width)))
    left = x.select(by, F.explode(F.array("b", F.col("b") + 1)).alias("b"), F.col("work_order_id").alias("l_id"), F.col("t").alias("l_t"))
    right = x.select(by, "b", F.col("work_order_id").alias("r_id"), F.col("t").alias("r_t"))
    near = (F.col("r_t") - F.col("l_t")).between(0, width) & ((F.col("l_t") < F.col("r_t")) | (F.col("l_id") < F.col("r_id"))) & (F.col("l_id") != F.col("r_id"))
    return left.join(right, [by, "b"]).filter(near).select(F.least("l_id", "r_id").alias("source"), F.greatest("l_id", "r_id").alias("target")).distinct()


def neighbour_pairs(rows: DataFrame, by: str = "family", most: int = K.NEIGHBOURS, days: float = K.PAIR_DAYS, skip: str = K.UNKNOWN, slice_days: float = 30) -> DataFrame:
    """Distinct (source, target) of each job and the next ``most`` of its family within ``days``; ids in order.

    Ranks are global in a family but come from ranks within time slices plus the counts of earlier slices, so no
    task sorts a whole family.
    """
    x = rows.filter(F.col(by) != skip).select(by, "work_order_id", V.micros(F.col("occurred_at")).alias("t")).distinct().withColumn("s", F.floor(F.col("t") / F.lit(int(slice_days * DAY))))
    sizes = x.groupBy(by, "s").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(by, "s", "before")
    ranked = x.withColumn("r", F.row_number().over(Window.partitionBy(by, "s").orderBy("t", "work_order_id"))).join(before, [by, "s"]).select(by, "work_order_id", "t", (F.col("r") + F.col("before")).alias("r"))
    left = ranked.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).select(by, (F.col("r") + F.col("k")).alias("r"), F.col("work_order_id").alias("l_id"), F.col("t").alias("l_t"))
    right = ranked.select(by, "r", F.col("work_order_id").alias("r_id"), F.col("t").alias("r_t"))
    near = (F.col("r_t") - F.col("l_t") <= int(days * DAY)) & (F.col("l_id") != F.col("r_id"))
    return left.join(right, [by, "r"]).filter(near).select(F.least("l_id", "r_id").alias("source"), F.greatest("l_id", "r_id").alias("target")).distinct()


def anchor_pairs(orders: DataFrame, days: float = K.PAIR_DAYS) -> DataFrame:
    """The candidates that share an anchor. Neighbours of a family that do are among them, as they are no further apart."""
    own = F.when(F.size("primary_asset_keys") > 0, F.col("primary_asset_keys")).otherwise(F.col("asset_keys"))
    return window_pairs(orders.select("work_order_id", "occurred_at", F.explode(own).alias("asset_key")), days=days)


def ids_repeat(orders: DataFrame) -> bool:
    """Whether several rows share a job's id."""
    return not orders.groupBy("work_order_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


#: Windows a bucket of ``scored_anchor_pairs`` is wide.
WIDE = 4


def scored_anchor_pairs(orders: DataFrame, days: float = K.PAIR_DAYS, weights=K.EDGE_WEIGHTS, semantic: Column | None = None, carried=(), within=()) -> DataFrame:
    """``score_edges`` of ``anchor_pairs`` where ids don't repeat, with what both ends share of ``within``, if that is named.

    Both ends bring their columns to where they meet, so pairs are neither made distinct nor joined by id. A job meets
    its own bucket, and the next one if that begins within ``days``; a pair of several shared anchors counts at the least.
    """
    width = int(days * DAY)
    own = F.when(F.size("primary_asset_keys") > 0, F.col("primary_asset_keys")).otherwise(F.col("asset_keys"))
    columns = ["work_order_id", "occurred_at", "family", "own", "asset_keys", *carried]
    end = orders.withColumn("own", own).select(*within, F.explode(F.array_distinct("own")).alias("_by"), *columns)
    end = end.withColumn("t", V.micros(F.col("occurred_at"))).withColumn("_b", F.floor(F.col("t") / F.lit(WIDE * width)))
    side = lambda df, p: df.select(*within, "_by", "_b", *(F.col(c).alias(f"{p}_{c}") for c in (*columns, "t")))
    reaches = F.col("t") >= (F.col("_b") + 1) * (WIDE * width) - width
    left = side(end.withColumn("_b", F.explode(F.when(reaches, F.array("_b", F.col("_b") + 1)).otherwise(F.array("_b")))), "l")
    first = F.col("l_work_order_id") < F.col("r_work_order_id")
    near = (F.col("r_t") - F.col("l_t")).between(0, width) & ((F.col("l_t") < F.col("r_t")) | first) & (F.col("l_work_order_id") != F.col("r_work_order_id"))
    near = near & (F.col("_by") == F.array_min(F.array_intersect("l_own", "r_own")))
    ends = [F.when(first, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")).alias(f"{a}_{c}") for c in columns for a, b in ("lr", "rl")]
    # a generator, which no later filter goes below: a filter on the scores would be joined by and come before the test of time
    x = left.join(side(end, "r"), [*within, "_by", "_b"]).select(F.inline(F.when(near, F.array(F.struct(*within, *ends)))))
    x = x.withColumnsRenamed({"l_work_order_id": "source", "r_work_order_id": "target"})
    return _scored(x, days, weights, semantic, within)


def candidate_pairs(orders: DataFrame, days: float = K.PAIR_DAYS, neighbours: int = K.NEIGHBOURS) -> DataFrame:
    """``orders``: work_order_id, occurred_at, family, primary_asset_keys, asset_keys."""
    return anchor_pairs(orders, days).union(neighbour_pairs(orders, most=neighbours, days=days)).distinct()


def score_edges(pairs: DataFrame, orders: DataFrame, days: float = K.PAIR_DAYS, weights=K.EDGE_WEIGHTS, semantic: Column | None = None, carried=()) -> DataFrame:
    """``pairs`` (source, target, semantic) with the parts of their score, the weight and its reasons in words.

    ``semantic``: the similarity as a column of both ends' ``carried`` columns, l_ and r_, where the pairs have none.
    """
    own = F.when(F.size("primary_asset_keys") > 0, F.col("primary_asset_keys")).otherwise(F.col("asset_keys"))
    end = orders.select("work_order_id", "occurred_at", "family", own.alias("own"), "asset_keys", *carried)
    side = lambda p, key: end.select(*(F.col(c).alias(f"{p}_{c}") for c in end.columns)).withColumnRenamed(f"{p}_work_order_id", key)
    return _scored(pairs.join(side("l", "source"), "source").join(side("r", "target"), "target"), days, weights, semantic)


def _scored(x: DataFrame, days: float, weights, semantic: Column | None, within=()) -> DataFrame:
    """The parts of the score of pairs that have the columns of both ends, l_ and r_."""
    if semantic is not None:
        x = x.withColumn("semantic", semantic)
    main, shared = F.array_intersect("l_own", "r_own"), F.array_intersect("l_asset_keys", "r_asset_keys")
    apart = F.abs(V.day_span(F.col("l_occurred_at"), F.col("r_occurred_at")))
    x = x.withColumn("shared_anchors", F.array_sort(main)).withColumn("same_asset", F.size(main) > 0).withColumn("related_asset", F.size(F.array_except(shared, main)) > 0)
    x = x.withColumn("days_apart", F.bround(apart).cast("long")).withColumn("temporal_score", F.greatest(F.lit(0.0), 1.0 - apart / F.lit(float(days))))
    x = x.withColumn("same_issue_family", (F.col("l_family") == F.col("r_family")) & (F.col("l_family") != K.UNKNOWN))
    w = (
        weights["semantic"] * F.col("semantic")
        + weights["asset"] * F.when(F.col("same_asset"), 1.0).when(F.col("related_asset"), 0.5).otherwise(0.0)
        + weights["temporal"] * F.col("temporal_score")
        + weights["issue"] * F.col("same_issue_family").cast("double")
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("same_asset"), F.concat(F.lit("shared asset "), F.array_min(shared))),
            F.when(F.col("related_asset"), F.lit("co-attached related asset")),
            F.when(F.col("same_issue_family"), F.concat(F.lit("same issue family: "), F.col("l_family"))),
            F.concat(F.col("days_apart").cast("string"), F.lit(" days apart")),
            F.format_string("semantic similarity %.2f", F.col("semantic")),
        )
    )
    x = x.withColumn("weight", F.least(F.lit(1.0), F.greatest(F.lit(0.0), w))).withColumn("reasons", reasons)
    return x.select(*within, "source", "target", "semantic", "same_asset", "related_asset", "days_apart", "temporal_score", "same_issue_family", "weight", "reasons", "shared_anchors", F.col("l_family").alias("source_family"), F.col("r_family").alias("target_family"))


def admitted(edges: DataFrame, threshold: float = K.EDGE_THRESHOLD) -> DataFrame:
    """Edges between jobs of one anchor whose families agree or aren't both known, and that weigh enough."""
    agree = (F.col("source_family") == F.col("target_family")) | (F.col("source_family") == K.UNKNOWN) | (F.col("target_family") == K.UNKNOWN)
    equipment = F.exists("shared_anchors", lambda a: V.asset_class(F.split_part(a, F.lit(":"), F.lit(1))) == "equipment")
    return edges.filter(F.col("same_asset") & agree & (equipment | F.col("same_issue_family")) & (F.col("weight") >= threshold))
