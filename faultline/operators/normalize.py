"""Normalisation of the three source tables and the checks on what comes out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions import values as V


def first_wins(df: DataFrame, *key: str, order: str | tuple[str, ...] = "row_idx") -> DataFrame:
    """The first row of each key; where ``order`` can tie, further columns of it decide."""
    by = (order,) if isinstance(order, str) else order
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).filter("_n = 1").drop("_n")


def with_row_index(df: DataFrame) -> DataFrame:
    return df if "row_idx" in df.columns else df.withColumn("row_idx", F.monotonically_increasing_id())


def normalize_work_orders(df: DataFrame, as_of) -> DataFrame:
    """One row per valid id, the first in source order: canonical columns with defaults and site."""
    as_of = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    x = with_row_index(df).withColumn("work_order_id", F.trim("work_order_id")).withColumn("occurred_at", V.parse_timestamp(F.col("date"), as_of))
    x = first_wins(x.filter(V.valid_identifier(F.col("work_order_id")) & F.col("occurred_at").isNotNull()), "work_order_id")
    return x.select(
        "work_order_id",
        "occurred_at",
        F.coalesce(V.label(F.col("category")), F.lit("unknown")).alias("category"),
        F.coalesce(V.label(F.col("department"), upper=True), F.lit("unknown")).alias("department"),
        F.coalesce(F.trim("priority"), F.lit("normal")).alias("priority"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("address", "location").alias("site"),
        V.tri_state(F.col("is_reactive")).alias("is_reactive"),
        "description",
        "row_idx",
    )


def bulk_jobs(links: DataFrame, most: int = K.MAX_ASSETS_PER_JOB) -> DataFrame:
    """Jobs with more than ``most`` distinct valid assets. ``links``: work_order_id, asset_key (null if invalid)."""
    return links.groupBy("work_order_id").agg(F.count_distinct("asset_key").alias("assets")).filter(F.col("assets") > most)


def link_candidates(df: DataFrame, most: int = K.MAX_ASSETS_PER_JOB) -> DataFrame:
    """Valid links of jobs that aren't bulk: one row per (job, asset), the highest role, the earliest on ties."""
    ok = V.valid_identifier(F.col("entity_type")) & V.valid_identifier(F.col("entity_uid"), allow_zero=True) & V.valid_identifier(F.col("work_order_id"))
    role = F.lower(F.trim(F.coalesce("role", F.lit("primary"))))
    x = with_row_index(df).select(
        F.trim("work_order_id").alias("work_order_id"), F.when(ok, V.asset_key(F.col("entity_type"), F.col("entity_uid"))).alias("asset_key"),
        V.asset_class(F.col("entity_type")).alias("asset_class"), role.alias("role"), V.role_priority(role).alias("priority"), "row_idx",
    )
    x = x.join(bulk_jobs(x, most).select("work_order_id"), "work_order_id", "left_anti").filter("asset_key IS NOT NULL")
    at = Window.partitionBy("work_order_id", "asset_key").orderBy(F.desc("priority"), "row_idx")
    return x.withColumn("_n", F.row_number().over(at)).filter("_n = 1").drop("_n")


def catch_all_assets(links: DataFrame, floor: int = K.CATCH_ALL_JOBS, named=K.CATCH_ALL_ASSETS) -> DataFrame:
    """Assets that stand for many things: named ones, and those with ``floor`` links or more."""
    return links.groupBy("asset_key").agg(F.count("*").alias("links")).filter((F.col("links") >= floor) | F.col("asset_key").isin(*named))


def drop_catch_all(links: DataFrame, floor: int = K.CATCH_ALL_JOBS, named=K.CATCH_ALL_ASSETS) -> DataFrame:
    return links.join(catch_all_assets(links, floor, named).select("asset_key"), "asset_key", "left_anti")


def normalize_comments(df: DataFrame) -> DataFrame:
    """Notes with raw, clean and redacted text apart; first of each id wins."""
    x = with_row_index(df).filter(V.valid_identifier(F.col("work_order_id")) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    x = X.corpus_boilerplate(x)
    idx = F.col("row_idx")
    id_ = F.coalesce(F.when(V.valid_identifier(F.col("comment_id")), F.trim("comment_id")), F.concat(F.lit("COMMENT-"), idx.cast("string")))
    x = x.withColumn("comment_id", id_).withColumn("source_sequence", F.coalesce(F.expr("try_cast(comment_id AS BIGINT)"), idx))
    clean = F.when(F.col("is_boilerplate"), "").otherwise(X.clean_note(F.col("text")))
    x = first_wins(x, "comment_id").withColumn("cleaned", clean).withColumn("_r", X.redact_pii(F.col("cleaned")))
    return x.select(F.trim("work_order_id").alias("work_order_id"), "comment_id", "source_sequence", F.col("text").alias("raw"), "cleaned", F.col("_r.text").alias("redacted"), F.col("_r.was_redacted").alias("was_redacted"), F.col("_r.kinds").alias("kinds"))


def with_known(children: DataFrame, parents: DataFrame, key: str = "work_order_id") -> DataFrame:
    return children.join(parents.select(key), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, key: str = "work_order_id") -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def anchors(links: DataFrame) -> DataFrame:
    """Links that anchor a job: those of its highest role tier (primary, else fallback), equipment before location."""
    rank = F.when(F.col("priority") > 0, (2 - F.col("priority")) * 2 + F.when(F.col("asset_class") == "location", 1).otherwise(0))
    x = links.withColumn("_rank", rank)
    least = F.min("_rank").over(Window.partitionBy("work_order_id"))
    return x.withColumn("_least", least).filter("_rank = _least").drop("_rank", "_least")


def nest(orders: DataFrame, links: DataFrame, comments: DataFrame) -> DataFrame:
    """Orders with their assets, anchors and notes in arrays, and whether they can be analysed, with the reason."""
    by = links.groupBy("work_order_id").agg(F.array_sort(F.collect_set("asset_key")).alias("asset_keys"))
    main = anchors(links).groupBy("work_order_id").agg(F.array_sort(F.collect_set("asset_key")).alias("primary_asset_keys"))
    said = comments.filter("cleaned <> ''").groupBy("work_order_id").agg(F.array_sort(F.collect_list(F.struct("source_sequence", "comment_id", "cleaned", "redacted"))).alias("_notes"))
    none = F.array().cast("array<string>")
    x = orders.join(by, "work_order_id").join(main, "work_order_id", "left").join(said, "work_order_id", "left")
    x = x.withColumn("primary_asset_keys", F.coalesce("primary_asset_keys", none))
    x = x.withColumn("cleaned_notes", F.coalesce(F.transform("_notes", lambda n: n["cleaned"]), none)).withColumn("redacted_notes", F.coalesce(F.transform("_notes", lambda n: n["redacted"]), none)).drop("_notes")
    note = F.array_join("cleaned_notes", " ")
    why = F.when(F.size("primary_asset_keys") == 0, "no_anchor").when(F.size("cleaned_notes") == 0, "no_note").when(~X.is_maintenance(note), "not_maintenance").otherwise("eligible")
    return x.withColumn("eligibility", why).withColumn("eligible", F.col("eligibility") == "eligible")


def bridge(links: DataFrame, orders: DataFrame) -> DataFrame:
    """Links with what their jobs say, null for unknown jobs."""
    return links.join(orders, "work_order_id", "left")


def attach_notes(notes: DataFrame) -> DataFrame:
    """(work_order_id, note): a job's texts in order, joined by blanks."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("source_sequence", "text"))), lambda n: n["text"])
    return notes.groupBy("work_order_id").agg(F.array_join(said, " ").alias("note"))


class Counters:
    """Counts that are taken in the pass that writes a table, so that no counter needs a scan of its own."""

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, name: str, **kinds: Column) -> DataFrame:
        """``df``, of which the rows that meet each condition are counted as it is written once."""
        seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
        self._seen.append((name, seen))
        return df.observe(seen, *(F.count_if(c).alias(k) for k, c in kinds.items()))

    def counts(self) -> dict[tuple[str, str], int]:
        """{(name, kind): n} of what has been written."""
        return {(name, kind): n for name, seen in self._seen for kind, n in seen.get.items()}

    def report(self, spark: SparkSession) -> DataFrame:
        """(name, kind, n), a row for each counter."""
        return spark.createDataFrame([(*k, n) for k, n in self.counts().items()], "name string, kind string, n long")


def violations(df: DataFrame, key: str, **checks) -> DataFrame:
    """(key, failed checks) of rows that break a contract; a check is a column that must be true."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    return df.select(F.col(key).alias("key"), failed.alias("failed")).filter(F.size("failed") > 0)


def require(found: DataFrame) -> None:
    bad = found.limit(5).collect()
    if bad:
        raise ValueError(f"contract violations: {bad}")


def register_filter(df: DataFrame, *, start=None, end=None, recurring: bool | None = None, **equal: str | None) -> DataFrame:
    """Case-insensitive equality on columns and overlap of [first_seen, last_seen] with [start, end] in days."""
    if start and end and str(start) > str(end):
        raise ValueError("start lies after end")
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.lower(c) == v.lower())
    if recurring is not None:
        df = df.filter(F.col("recurring") == recurring)
    if start:
        df = df.filter(F.to_date("last_seen") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.to_date("first_seen") <= F.lit(end).cast("date"))
    return df


def facets(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))
