"""Profiles of a corpus of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.store import materialise
from .segments import least_hashes


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    x = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_last())
    return x if k is None else x.limit(k)


def describe(df: DataFrame, value: F.Column) -> DataFrame:
    return df.agg(F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("most"))


def null_shares(df: DataFrame) -> DataFrame:
    x = df.agg(*((100.0 * F.avg(F.col(c).isNull().cast("double"))).alias(c) for c in df.columns))
    return x.unpivot([], df.columns, "column", "null_percent")


def distinct_counts(df: DataFrame, *columns: str, approximate: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*(f(c).alias(c) for c in columns))


def repeat_assets(links: DataFrame, ks=(2, 3, 5, 10)) -> DataFrame:
    """How many assets have at least k distinct jobs, for each k."""
    n = links.groupBy("asset_key").agg(F.count_distinct("work_order_id").alias("jobs"))
    return n.agg(*(F.count_if(F.col("jobs") >= k).alias(f"at_least_{k}") for k in ks))


def per_year(df: DataFrame, ts: str = "occurred_at") -> DataFrame:
    return df.groupBy(F.year(ts).alias("year")).agg(F.count("*").alias("n"))


def with_assets_per_job(links: DataFrame, cap: int = 10) -> DataFrame:
    """Links with the number of links of their job; jobs over the cap are left out."""
    return links.withColumn("assets", F.count("*").over(Window.partitionBy("work_order_id"))).filter(F.col("assets") <= cap)


def stratified_sample(df: DataFrame, by: str, fraction: float, key: str, seed: str = "s") -> DataFrame:
    """max(1, round(n * fraction)) rows of each stratum, null among them: those with the least hashes. ``key`` tells rows apart. No stratum is sorted."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    hashed = materialise(df.select(F.col(by).alias("_by"), h.alias("_h")), "hashed")
    want = hashed.groupBy("_by").agg(F.greatest(F.lit(1), F.bround(F.count("*") * fraction)).cast("long").alias("k"))
    bound = least_hashes(hashed, "_by", "_h", want).withColumnsRenamed({"_by": "_st"})
    return df.join(bound, F.col(by).eqNullSafe(F.col("_st"))).filter(h <= F.col("bound")).drop("_st", "bound")


def repeat_by_type(links: DataFrame, least: int = 3, k: int = 10) -> DataFrame:
    n = links.groupBy("asset_key").agg(F.count_distinct("work_order_id").alias("jobs")).filter(F.col("jobs") >= least)
    return n.groupBy(F.split_part("asset_key", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count("*").alias("assets")).orderBy(F.desc("assets"), "kind").limit(k)


def dense_sites(rows: DataFrame, least: int = 3, site: str = "site") -> DataFrame:
    return rows.groupBy(site).agg(F.count_distinct("asset_key").alias("assets"), F.count_distinct("department").alias("departments")).filter((F.col("assets") >= least) & (F.col("departments") >= least))


def site_story(rows: DataFrame, site: str, where: str = "site", excerpt: int = 110) -> DataFrame:
    x = rows.filter(F.col(where) == site)
    said = F.transform(F.array_sort(F.collect_list(F.struct("occurred_at", F.substring("note", 1, excerpt).alias("note")))), lambda r: r["note"])
    return x.groupBy("asset_key").agg(F.count("*").alias("jobs"), V.floor_days(F.max("occurred_at"), F.min("occurred_at")).alias("span_days"), said.alias("excerpts"))


def keyword_shares(df: DataFrame, text: str, families: dict[str, tuple[str, ...]]) -> DataFrame:
    """How many texts hold a substring of each family's words, and their share."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = {f: F.greatest(*(F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0), F.lit(0)) for f, words in families.items()}
    one = df.agg(F.count("*").alias("_n"), *(F.sum(h).alias(f) for f, h in hit.items()))
    return one.unpivot(["_n"], list(families), "family", "n").select("family", "n", (F.col("n") / F.col("_n")).alias("share"))
