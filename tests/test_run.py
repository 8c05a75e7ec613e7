"""The batch run on a tiny source, and episodes over a stream."""

import json

from faultline.plans import run as R
from faultline.sources import tables
from faultline.streaming.episodes import stream_episodes

WORK = """WorkOrderId,InitiateDate,Shop,Priority
1,2024-01-01T00:00:00Z,water,3
2,2024-02-01T00:00:00Z,water,3
3,2024-03-02T00:00:00Z,water,High
4,2024-03-02T00:00:00Z,roads,3
4,2024-05-02T00:00:00Z,roads,3
5,1970-01-01,roads,3
"""
LINKS = "WorkOrderId,EntityType,EntityUid,RelationshipType\n" + "".join(f"{i},PUMP,20,appliesto\n" for i in (1, 2, 3)) + "4,HYDRANT,7,appliesto\n"
NOTES = """CommentId,WorkOrderId,Comments
1,1,"Water leak at the service line, valve leaking."
2,2,"Water leak again near the hydrant, repaired the line."
3,3,"Standing water and water leak, caused by a cracked seal. Returned to service."
4,4,"Picked up supply order for the crew."
"""


def test_batch_run(spark, tmp_path):
    for name, body in (("WORKORDER", WORK), ("WOENTITY", LINKS), ("WOCOMMENT", NOTES)):
        (tmp_path / f"{name}.csv").write_text(body)
    root = str(tmp_path / "store")
    run_id = R.run(spark, str(tmp_path), root, "2025-01-01")
    assert tables.current_run(spark, root) == run_id
    orders = {r.work_order_id: r for r in tables.read_snapshot(spark, root, "orders").collect()}
    assert set(orders) == {"1", "2", "3", "4"} and orders["4"].eligibility == "not_maintenance" and orders["1"].family == "water_leak"
    (i,) = tables.read_snapshot(spark, root, "incidents").collect()
    assert i.asset_key == "PUMP:20" and i.recurring and i.jobs == 3 and i.resolution_status == "RESOLVED"
    (f,) = tables.read_snapshot(spark, root, "insights").collect()
    assert f.possible_cause.support_level == "SUPPORTED" and f.pm_interval_recommendation.interval_days == 30.5
    assert tables.latest_run(spark, root).first().rejected == 2
    assert [r.sequence for r in tables.read_snapshot(spark, root, "members").orderBy("sequence").collect()] == [0, 1, 2]


def test_rerun_keeps_reviews_and_history(spark, tmp_path):
    """A decision with a family edit outlives a rerun; when its finding is gone it is archived with what it was about."""
    source, root = tmp_path / "source", str(tmp_path / "store")
    source.mkdir()
    for name, body in (("WORKORDER", WORK), ("WOENTITY", LINKS), ("WOCOMMENT", NOTES.replace("Water leak", "Wet").replace("water leak", "wet").replace("caused by a cracked seal", "no cause"))):
        (source / f"{name}.csv").write_text(body)
    R.run(spark, str(source), root, "2025-01-01")
    kept = tables.read_snapshot(spark, root, "reviews").orderBy("incident_id").first()
    assert kept.decision == "pending" and not kept.archived
    log = spark.createDataFrame([(kept.review_id, "approved", "pothole", True, "2025-01-02")], "review_id string, decision string, edited_family string, sets_family boolean, decided_at string").selectExpr("* EXCEPT (decided_at)", "CAST(decided_at AS TIMESTAMP) AS decided_at")
    R.decide(spark, root, log)
    family = lambda: {r.incident_id: r.family for r in tables.read_snapshot(spark, root, "incidents").collect()}
    review = lambda: {r.incident_id: r for r in tables.read_snapshot(spark, root, "reviews").collect()}[kept.incident_id]
    assert family()[kept.incident_id] == "pothole" and review().decision == "approved"
    R.run(spark, str(source), root, "2025-01-01")
    assert family()[kept.incident_id] == "pothole" and review().decision == "approved" and not review().archived
    assert tables.read_snapshot(spark, root, "run_history").count() == 2
    (source / "WOENTITY.csv").write_text(LINKS.replace("PUMP,20", "PUMP,21").replace("1,PUMP", "9,PUMP"))
    R.run(spark, str(source), root, "2025-01-01")
    gone = review()
    assert gone.archived and gone.decision == "approved" and kept.incident_id not in family()
    assert json.loads(gone.snapshot)["incident"]["asset_key"] == "PUMP:20"
    assert tables.latest_run(spark, root).first().run_id == tables.current_run(spark, root) and tables.read_snapshot(spark, root, "run_history").count() == 3


def test_streamed_episodes(spark, tmp_path):
    days = {"a": (1, 5, 9, 200, 210), "b": (3,), "z": (400, 800)}
    rows = [(k, f"2023-01-01 00:00:00", d) for k, ds in days.items() for d in ds]
    df = spark.createDataFrame(rows, "asset_key string, t string, d int").selectExpr("asset_key", "timestampadd(DAY, d, CAST(t AS TIMESTAMP)) AS occurred_at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_episodes(stream, "101 days", "1 day").writeStream.outputMode("append").format("memory").queryName("episodes").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.asset_key, r.jobs) for r in spark.sql("SELECT * FROM episodes").collect()) == [("a", 2), ("a", 3), ("b", 1), ("z", 1)]
