"""Incident groups under constraints, incident rows, gap episodes, timelines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import values as V
from ..sources.store import materialise
from . import segments as S


#: Edges of a component that one task may hold.
MOST_EDGES = 200_000


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over ``edges`` (source, target), for every row of ``nodes`` (id).

    Labels spread along edges and jump to their label's label, so rounds grow with the logarithm of path length.
    """
    both = materialise(edges.select("source", "target").union(edges.select("target", "source")).distinct(), "edges")
    labels = materialise(nodes.select("id").distinct().withColumn("component", F.col("id")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.min("component").alias("seen"))
        met = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("seen", "component")).alias("component"))
        jump = met.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = materialise(met.join(jump, "component", "left").select("id", "was", F.coalesce("further", "component").alias("component")), "labels")
        if new.filter("was <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def _greedy(span_us: int, strict: bool):
    """Merge in edge order while anchors intersect and the span holds; one connected component at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        info = {}
        for end in ("source", "target"):
            for i, t, own, family in zip(pdf[end], pdf[f"{end}_t"], pdf[f"{end}_own"], pdf[f"{end}_family"]):
                info[i] = [t, t, frozenset(own), frozenset() if family == K.UNKNOWN else frozenset([family])]
        root = {i: i for i in info}

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for s, t in pdf.sort_values(["weight", "source", "target"], ascending=[False, True, True])[["source", "target"]].itertuples(index=False):
            a, b = find(s), find(t)
            if a == b:
                continue
            x, y = info[a], info[b]
            first, last, shared, families = min(x[0], y[0]), max(x[1], y[1]), x[2] & y[2], x[3] | y[3]
            if shared and last - first <= span_us and not (strict and len(families) > 1):
                root[b] = a
                info[a] = [first, last, shared, families]
        return pd.DataFrame({"id": list(root), "group": [find(i) for i in root]})

    return run


def _walk_in_rounds(edges: DataFrame, ends: DataFrame, span_us: int, strict: bool) -> DataFrame:
    """(id, group) as ``_greedy`` gives them, by joins alone, for components too large for one task.

    An edge that comes first at both of its groups is next for them in the serial walk, whatever happens elsewhere, so
    all such edges are decided at once. What a refusal rests on only gets worse as groups grow: of the edges between two
    groups the first one speaks for all, and once refused they are gone.
    """
    ids = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    known = F.when(F.col("family") == K.UNKNOWN, F.array().cast("array<string>")).otherwise(F.array("family"))
    state = ends.join(ids, ends.work_order_id == ids.id).select(F.col("id").alias("group"), F.col("t").alias("first"), F.col("t").alias("last"), "own", known.alias("families"))
    state, labels = materialise(state, "states"), materialise(ids.withColumn("group", F.col("id")), "groups")
    key = F.struct((-F.col("weight")).alias("w"), "source", "target")
    live = materialise(edges.select(F.col("source").alias("a"), F.col("target").alias("b"), key.alias("key")), "live")
    while not live.isEmpty():
        pair = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")]
        live = live.groupBy(*pair).agg(F.min(F.struct("key", "a", "b")).alias("m")).select("m.key", "m.a", "m.b")
        best = live.select(F.explode(F.array("a", "b")).alias("g"), "key").groupBy("g").agg(F.min("key").alias("best"))
        at = lambda c: best.select(F.col("g").alias(c), F.col("best").alias(f"best_{c}"))
        met = materialise(live.join(at("a"), "a").join(at("b"), "b").withColumn("now", (F.col("key") == F.col("best_a")) & (F.col("key") == F.col("best_b"))), "met")
        side = lambda c: state.select(*(F.col(x).alias(f"{c}_{x}" if x != "group" else c) for x in state.columns))
        x = met.filter("now").join(side("a"), "a").join(side("b"), "b")
        x = x.withColumn("first", F.least("a_first", "b_first")).withColumn("last", F.greatest("a_last", "b_last"))
        x = x.withColumn("own", F.array_intersect("a_own", "b_own")).withColumn("families", F.array_union("a_families", "b_families"))
        ok = (F.size("own") > 0) & (F.col("last") - F.col("first") <= span_us)
        merged = materialise(x.filter(ok & (F.size("families") <= 1) if strict else ok).select("a", "b", "first", "last", "own", "families"), "merged")
        into = merged.select(F.col("b").alias("old"), F.col("a").alias("new"))
        moved = lambda df, c: df.join(into.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        gone = merged.select(F.explode(F.array("a", "b")).alias("group"))
        state = materialise(state.join(gone, "group", "left_anti").unionByName(merged.select(F.col("a").alias("group"), "first", "last", "own", "families")), "states")
        labels = materialise(moved(labels, "group"), "groups")
        rest = moved(moved(met.filter("NOT now").select("key", "a", "b"), "a"), "b").filter("a <> b")
        live = materialise(rest, "live")
    return labels


def constrained_groups(edges: DataFrame, orders: DataFrame, span_days: float = K.SPAN_DAYS, strict_family: bool = False, most: int = MOST_EDGES) -> DataFrame:
    """(work_order_id, group) of every order, merging ``edges`` in the order (-weight, source, target).

    Merges never leave a connected component, so components are found with joins first and the order-dependent part
    runs on each by itself: exact, and as parallel as there are components. A component of more than ``most`` edges is
    no frame of one task but goes through rounds of joins with the same result.
    """
    own = F.when(F.size("primary_asset_keys") > 0, F.col("primary_asset_keys")).otherwise(F.col("asset_keys"))
    ids = orders.select(F.col("work_order_id").alias("id"))
    labels = connected_components(edges, edges.select(F.col("source").alias("id")).union(edges.select("target")))
    end = orders.select("work_order_id", V.micros(F.col("occurred_at")).alias("t"), own.alias("own"), "family")
    side = lambda p: end.select(*(F.col(c).alias(p if c == "work_order_id" else f"{p}_{c}") for c in end.columns))
    placed = materialise(edges.select("source", "target", "weight").join(labels.withColumnRenamed("id", "source"), "source"), "placed")
    large = materialise(placed.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("component"), "large")
    small = placed.join(large, "component", "left_anti").join(side("source"), "source").join(side("target"), "target")
    span = int(span_days * 86_400_000_000)
    merged = small.groupBy("component").applyInPandas(_greedy(span, strict_family), "id string, group string")
    if not large.isEmpty():
        merged = merged.unionByName(_walk_in_rounds(placed.join(large, "component", "left_semi"), end, span, strict_family))
    return ids.join(merged, "id", "left").select(F.col("id").alias("work_order_id"), F.coalesce("group", "id").alias("group"))


def mode_first(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """The most frequent value of each key, the earliest in position on ties, and its rows (_rows)."""
    x = df.groupBy(key, value).agg(F.count("*").alias("_c"), F.min(position).alias("_p"))
    best = x.groupBy(key).agg(F.min(F.struct((-F.col("_c")).alias("c"), "_p", F.col(value).alias("v"))).alias("_b"))
    return best.select(key, F.col("_b.v").alias(value), (-F.col("_b.c")).alias("_rows"))


def _incident_id(digits: int) -> Column:
    """An id holds ``digits`` hex digits of the digest of its jobs. 8 are the short form, of which tens of thousands of
    incidents begin to share some; ``K.ID_DIGITS`` tell any number apart."""
    hashed = F.upper(F.substring(F.sha1(F.concat_ws("|", F.array_sort(F.collect_list("work_order_id")))), 1, digits))
    return F.concat(F.lit("INC-"), hashed).alias("incident_id")


def incident_ids(jobs: DataFrame, digits: int = 8) -> DataFrame:
    """(group, incident_id) of each group of ``jobs`` (work_order_id, group), for those who need no more of an incident."""
    return jobs.groupBy("group").agg(_incident_id(digits))


def build_incidents(groups: DataFrame, orders: DataFrame, least_recurring: int = 3, digits: int = 8) -> DataFrame:
    """One row per group. ``orders``: work_order_id, occurred_at, family, department, primary_asset_keys, signal."""
    return incidents_of(groups.join(orders, "work_order_id"), least_recurring, digits)


def incidents_of(jobs: DataFrame, least_recurring: int = 3, digits: int = 8) -> DataFrame:
    """One row per group of ``jobs``: orders with their group."""
    own = F.when(F.size("primary_asset_keys") > 0, F.col("primary_asset_keys")).otherwise(F.col("asset_keys"))
    x = jobs.withColumn("own", own).withColumn("pos", F.struct("occurred_at", "work_order_id"))
    sets = F.collect_list("own")
    common = F.aggregate(F.slice(sets, 2, F.greatest(F.size(sets), F.lit(1))), F.element_at(sets, 1), lambda a, b: F.array_intersect(a, b))
    base = x.groupBy("group").agg(
        _incident_id(digits), F.array_min(common).alias("asset_key"), F.min("occurred_at").alias("first_seen"),
        F.max("occurred_at").alias("last_seen"), F.count("*").alias("jobs"), F.coalesce(F.max_by("signal", F.when(F.col("signal").isNotNull(), F.col("pos"))), F.lit("UNKNOWN")).alias("resolution_status"),
    )
    family = mode_first(x, "group", "family", "pos").withColumnRenamed("_rows", "same_family")
    base = base.join(family, "group").join(mode_first(x, "group", "department", "pos").drop("_rows"), "group")
    return base.withColumn("recurring", F.col("same_family") >= least_recurring)


def memberships(groups: DataFrame, incidents: DataFrame, orders: DataFrame, edges: DataFrame) -> DataFrame:
    """(incident_id, work_order_id, sequence, reason): time order, and the heaviest edge that ties a job to its group."""
    x = groups.join(incidents.select("group", "incident_id"), "group").join(orders.select("work_order_id", "occurred_at"), "work_order_id")
    return memberships_of(x, edges).drop("occurred_at")


def memberships_of(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """``memberships`` of jobs that carry their incident: incident_id, work_order_id, occurred_at."""
    x = jobs.select("incident_id", "work_order_id", "occurred_at")
    x = x.withColumn("sequence", F.row_number().over(Window.partitionBy("incident_id").orderBy("occurred_at", "work_order_id")) - 1)
    ends = edges.select(F.explode(F.array("source", "target")).alias("work_order_id"), "weight", "source", "target", "reasons")
    best = ends.withColumn("_n", F.row_number().over(Window.partitionBy("work_order_id").orderBy(F.desc("weight"), "source", "target"))).filter("_n = 1")
    return x.join(best.select("work_order_id", F.array_join("reasons", "; ").alias("reason")), "work_order_id", "left").select("incident_id", "work_order_id", "occurred_at", "sequence", F.coalesce("reason", F.lit("episode anchor")).alias("reason"))


def timeline(rows: DataFrame, key: str = "asset_key", ts: str = "occurred_at", tie: str = "work_order_id", slice_days: float = S.SLICE_DAYS) -> DataFrame:
    """``rows`` with floor days since the previous job of the asset."""
    x = S.last_before(S.sliced(rows, ts, slice_days), [key], ts, tie, F.col(ts), "_p")
    return x.withColumn("gap_days", V.floor_days(F.col(ts), F.col("_p"))).drop("_slice", "_p")


def with_episodes(rows: DataFrame, gap_days: float = 180, key: str = "asset_key", ts: str = "occurred_at", tie: str = "work_order_id", slice_days: float = S.SLICE_DAYS) -> DataFrame:
    """``rows`` with the number of their episode: a new one after more than ``gap_days`` floor days, and for every job without a time."""
    x = S.last_before(S.sliced(rows, ts, slice_days), [key], ts, tie, F.col(ts), "_p")
    gap = F.floor(V.day_span(F.col(ts), F.col("_p")))
    x = x.withColumn("_new", F.when(gap.isNull() | (gap > gap_days), 1).otherwise(0))
    return S.sums_before(x, [key], ts, tie, episode=F.col("_new")).withColumn("episode", F.col("episode") + F.col("_new")).drop("_slice", "_p", "_new")


def gap_episodes(rows: DataFrame, gap_days: float = 180, least: int = 3, most: int = 40, key: str = "asset_key", ts: str = "occurred_at", tie: str = "work_order_id", slice_days: float = S.SLICE_DAYS) -> DataFrame:
    """Episodes of each asset with ``least`` to ``most`` jobs."""
    return episodes_of(with_episodes(rows, gap_days, key, ts, tie, slice_days), least, most, key, ts)


def episodes_of(x: DataFrame, least: int = 3, most: int = 40, key: str = "asset_key", ts: str = "occurred_at") -> DataFrame:
    """Episodes with ``least`` to ``most`` jobs of rows that have their episode's number."""
    out = x.groupBy(key, "episode").agg(F.count("*").alias("jobs"), F.min(ts).alias("started"), F.max(ts).alias("ended"))
    return out.withColumn("span_days", V.floor_days(F.col("ended"), F.col("started"))).filter(F.col("jobs").between(least, most))
