"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as jobs; the customer's segment is the department."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("department"))
    o = table(spark, sf, "orders").join(c, "o_custkey")
    return o.select(F.col("o_orderkey").cast("string").alias("work_order_id"), F.col("o_orderdate").cast("timestamp").alias("occurred_at"), "department", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


JOBS_SQL = "jobs AS (SELECT CAST(o_orderkey AS VARCHAR) AS work_order_id, CAST(o_orderdate AS TIMESTAMP) AS occurred_at, c_mktsegment AS department, o_orderpriority AS priority, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey)"


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as links of a job to a part, with a role by return flag."""
    role = F.when(F.col("l_returnflag") == "A", "appliesto").when(F.col("l_returnflag") == "R", "attached").otherwise("other")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("work_order_id"), F.concat(F.lit("PART:"), F.col("l_partkey").cast("string")).alias("asset_key"), role.alias("role"), F.col("l_linenumber").cast("long").alias("row_idx"))


LINKS_SQL = "links AS (SELECT CAST(l_orderkey AS VARCHAR) AS work_order_id, 'PART:' || l_partkey AS asset_key, CASE l_returnflag WHEN 'A' THEN 'appliesto' WHEN 'R' THEN 'attached' ELSE 'other' END AS role, CAST(l_linenumber AS BIGINT) AS row_idx FROM lineitem)"


def histories(spark: SparkSession, sf: str) -> DataFrame:
    """Events as jobs on an asset (the user); one event type is the unknown family."""
    e = table(spark, sf, "events")
    family = F.when(F.col("event_type") == "view", K.UNKNOWN).otherwise(F.col("event_type"))
    return e.select(F.concat(F.lit("USER:"), F.col("user_id").cast("string")).alias("asset_key"), F.col("event_id").cast("string").alias("work_order_id"), F.col("ts").cast("timestamp").alias("occurred_at"), family.alias("family"), "value", (F.col("value") > 100).alias("repair"))


HISTORIES_SQL = f"histories AS (SELECT 'USER:' || user_id AS asset_key, CAST(event_id AS VARCHAR) AS work_order_id, CAST(ts AS TIMESTAMP) AS occurred_at, CASE event_type WHEN 'view' THEN '{K.UNKNOWN}' ELSE event_type END AS family, value, value > 100 AS repair FROM events)"
US = "epoch_us(occurred_at)"


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as notes of a job."""
    return table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("work_order_id"), F.col("turn").cast("string").alias("comment_id"), F.col("turn").alias("source_sequence"), "text")


def event_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Histories as canonical orders with arrays of assets."""
    return histories(spark, sf).withColumn("primary_asset_keys", F.array("asset_key")).withColumn("asset_keys", F.array("asset_key")).withColumn("department", F.col("family")).withColumn("signal", F.when(F.col("repair"), "REPAIR_RECORDED").otherwise("UNKNOWN"))
