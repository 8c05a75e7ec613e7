"""Gap episodes over a stream of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_episodes(jobs: DataFrame, gap: str = "181 days", late: str = "30 days", key: str = "asset_key", ts: str = "occurred_at") -> DataFrame:
    """Episodes of each asset as session windows: a job joins while less than ``gap`` has passed since the last one.

    State is one open session a key; sessions that ended more than ``late`` before the newest job are written out
    and forgotten. In append mode each episode appears once, when it can no longer change.
    """
    return (
        jobs.withWatermark(ts, late)
        .groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("jobs"), F.min(ts).alias("started"), F.max(ts).alias("ended"))
        .drop("w")
    )
