"""Scans along a key's rows in time slices: no task holds more than one slice of a key, however many rows it has.

A scan has three steps: each slice by itself, a summary for each slice (sums, the last or first value), a scan over the
summaries of a key, whose number is bounded by the time they span, and the summaries joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V

DAY = 86_400_000_000
SLICE_DAYS = 30.0
UNDATED = (1 << 63) - 1


def sliced(rows: DataFrame, ts: str, days: float = SLICE_DAYS) -> DataFrame:
    """``rows`` with _slice: the number of their time slice. Rows without a time are a slice of their own, the last one."""
    return rows.withColumn("_slice", F.coalesce(F.floor(V.micros(F.col(ts)) / F.lit(max(1, int(days * DAY)))).cast("long"), F.lit(UNDATED)))


def _order(ts: str, tie: str) -> list[Column]:
    return [F.col(ts).asc_nulls_last(), F.col(tie).asc()]


def sums_before(rows: DataFrame, key: list[str], ts: str, tie: str, **sums: Column) -> DataFrame:
    """``rows`` (sliced) with the sum of each column over all earlier rows of their key; 0 for the first."""
    x = rows.withColumns({f"_v_{n}": c for n, c in sums.items()})
    per = x.groupBy(*key, "_slice").agg(*(F.sum(f"_v_{n}").alias(n) for n in sums))
    earlier = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*key, "_slice", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums))
    own = Window.partitionBy(*key, "_slice").orderBy(*_order(ts, tie)).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(carry, [*key, "_slice"])
    x = x.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(own), F.lit(0)) + F.col(f"_c_{n}") for n in sums})
    return x.drop(*(f"_{p}_{n}" for n in sums for p in "vc"))


def last_before(rows: DataFrame, key: list[str], ts: str, tie: str, value: Column, name: str) -> DataFrame:
    """``rows`` (sliced) with the last value that isn't null of the earlier rows of their key."""
    x = rows.withColumn("_v", value)
    at = F.struct(F.col(ts).alias("t"), F.col(tie).alias("i"))
    per = x.groupBy(*key, "_slice").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), at)).alias("_l"))
    earlier = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*key, "_slice", F.last("_l", ignorenulls=True).over(earlier).alias("_c"))
    own = Window.partitionBy(*key, "_slice").orderBy(*_order(ts, tie)).rowsBetween(Window.unboundedPreceding, -1)
    return x.join(carry, [*key, "_slice"]).withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(own), "_c")).drop("_v", "_c")


def first_after(rows: DataFrame, key: list[str], ts: str, tie: str, value: Column, name: str) -> DataFrame:
    """``rows`` (sliced) with the first value that isn't null of the later rows of their key."""
    x = rows.withColumn("_v", value)
    at = F.struct(F.col(ts).alias("t"), F.col(tie).alias("i"))
    per = x.groupBy(*key, "_slice").agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), at)).alias("_l"))
    later = Window.partitionBy(*key).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    carry = per.select(*key, "_slice", F.first("_l", ignorenulls=True).over(later).alias("_c"))
    own = Window.partitionBy(*key, "_slice").orderBy(*_order(ts, tie)).rowsBetween(1, Window.unboundedFollowing)
    return x.join(carry, [*key, "_slice"]).withColumn(name, F.coalesce(F.first("_v", ignorenulls=True).over(own), "_c")).drop("_v", "_c")


# ---- the least of many hashes ----

#: Rows of a group that may be ranked as a whole.
FEW = 1000


def least_hashes(rows: DataFrame, stratum: str, hashed: str, want: DataFrame) -> DataFrame:
    """(stratum, bound): the hash of rank ``want.k`` in each stratum, so that the k least are those up to it.

    A radix select: rows are counted by one more byte of their hash in each round, which leaves the byte in which the k-th
    one lies, until that group is small. No stratum is sorted. ``hashed``: hex strings, distinct within a stratum;
    ``rows`` should be a written table. ``want``: stratum, k (1 at least); a k beyond a stratum's rows takes all of it.
    """
    from ..sources.store import materialise

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    r = rows.select(F.col(stratum).alias("_st"), F.col(hashed).alias("_h"))
    state = materialise(want.select(F.col(stratum).alias("w_st"), F.lit("").alias("prefix"), F.col("k").cast("long").alias("k")), "select")
    width = 0
    while True:
        width += 2
        inside = r.join(state, same("_st", "w_st") & F.startswith("_h", F.col("prefix")))
        counts = inside.groupBy("w_st", F.substring("_h", 1, width).alias("next"), "k").agg(F.count("*").alias("n"))
        w = Window.partitionBy("w_st").orderBy("next")
        counts = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.max("upto").over(Window.partitionBy("w_st")))  # 256 rows a stratum
        k = F.least("k", F.col("all"))
        state = counts.filter((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).select("w_st", F.col("next").alias("prefix"), (k - F.col("upto") + F.col("n")).alias("k"), "n")
        state = materialise(state, "select")
        if width >= 64 or (state.agg(F.max("n")).first()[0] or 0) <= FEW:
            break
    last = r.join(state.select("w_st", "prefix", "k"), same("_st", "w_st") & F.startswith("_h", F.col("prefix")))
    last = last.withColumn("_n", F.row_number().over(Window.partitionBy("w_st").orderBy("_h"))).filter(F.col("_n") == F.col("k"))
    return last.select(F.col("w_st").alias(stratum), F.col("_h").alias("bound"))
