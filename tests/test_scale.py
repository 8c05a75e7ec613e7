"""Operators that take their data in slices, blocks, cells and rounds, against plain versions of the same."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline import constants as K
from faultline.operators import ann, calibration, features, grouping, normalize, reviews, search, segments, sparse, vectors
from faultline.sources import manifest, tables
from faultline.sources.review_store import ReviewStore

T0 = datetime(2020, 1, 1)


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# ---- time slices ----


@pytest.fixture(scope="module")
def history(spark):
    """A third of all rows on one asset, equal times, and rows without a time."""
    r = random.Random(1)
    rows = []
    for i in range(900):
        t = None if i % 90 == 0 else T0 + timedelta(days=r.choice([0, 1, 2, 30, 31, 200, 500]), hours=r.randrange(3))
        rows.append((f"a{0 if i % 3 == 0 else r.randrange(20)}", f"{i:04d}", t, r.choice([K.UNKNOWN, "x", "y"]), r.random() < 0.5))
    return spark.createDataFrame(rows, "asset_key string, work_order_id string, occurred_at timestamp, family string, repair boolean").cache()


@pytest.mark.parametrize("days", [0.05, 7])
def test_slices_change_nothing(history, days):
    dated = history.filter("occurred_at IS NOT NULL")
    whole = 100_000
    for f, df, columns in (
        (lambda d, n: grouping.timeline(d, slice_days=n), history, ["work_order_id", "gap_days"]),
        (lambda d, n: grouping.with_episodes(d, 20, slice_days=n), history, ["work_order_id", "episode"]),
        (lambda d, n: features.nearest_known(d, 40, n), dated, ["work_order_id", "donor", "gap_us"]),
        (lambda d, n: features.temporal_features(d, (1, 30), n), dated, ["work_order_id", "days_since_previous", "jobs_1d", "jobs_30d", "recurrence_interval_days", "previous_repairs", "persistence"]),
    ):
        assert rows_of(f(df, days), *columns) == rows_of(f(df, whole), *columns)


def test_timeline_and_features_by_hand(spark):
    rows = [("a", str(i), T0 + timedelta(days=d), f, True) for i, (d, f) in enumerate([(0, "x"), (0, "x"), (10, K.UNKNOWN), (40, "x"), (41, "y")])]
    df = spark.createDataFrame(rows, "asset_key string, work_order_id string, occurred_at timestamp, family string, repair boolean")
    got = {r.work_order_id: (r.days_since_previous, r.jobs_30d, r.previous_repairs, r.recurrence_interval_days) for r in features.temporal_features(df, (30,), 1).collect()}
    assert got == {"0": (None, 0, 0, None), "1": (0, 1, 1, None), "2": (10, 2, 0, None), "3": (30, 1, 2, 0.0), "4": (1, 1, 0, None)}
    assert [r.donor for r in features.nearest_known(df, 30, 1).collect()] == ["1"]


def test_least_hashes(spark, monkeypatch):
    monkeypatch.setattr(segments, "FEW", 3)
    df = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("st"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    want = {None: 40, 0: 1, 1: 7, 2: 10_000}
    k = spark.createDataFrame(list(want.items()), "st long, k long")
    got = {r.st: r.bound for r in segments.least_hashes(df, "st", "h", k).collect()}
    all_of = {s: sorted(r.h for r in df.filter(F.col("st").eqNullSafe(F.lit(s))).collect()) for s in want}
    assert got == {s: all_of[s][min(n, len(all_of[s])) - 1] for s, n in want.items()}


# ---- isotonic ----


def plain_pav(points):
    out = []
    for x, y in sorted(points):
        if out and out[-1][0] == x:
            out[-1][1], out[-1][2] = out[-1][1] + y, out[-1][2] + 1
        else:
            out.append([x, y, 1])
    steps = []
    for b in out:
        steps.append(b)
        while len(steps) > 1 and steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]:
            _, y, n = steps.pop()
            steps[-1][1] += y
            steps[-1][2] += n
    return [(x, y / n) for x, y, n in steps]


@pytest.mark.parametrize("parts,fan", [(64, 8), (1, 2), (5, 2)])
def test_isotonic_blocks(spark, parts, fan):
    r = random.Random(2)
    points = [(round(r.random() ** 2, 3), int(r.random() < 0.3 + 0.4 * (i % 2))) for i in range(600)] + [(0.0, 1), (1.0, 0), (1.0, 1)]
    got = calibration.isotonic_blocks(spark.createDataFrame(points, "score double, label int"), parts, fan).orderBy("x").collect()
    want = plain_pav(points)
    assert len(got) == len(want) and np.allclose([tuple(r) for r in got], want)
    rising = [(i / 50, int(i > 25)) for i in range(50)]
    a = calibration.fit_isotonic(spark.createDataFrame(rising, "score double, label int")).first()
    assert np.allclose(list(zip(a.x_values, a.y_values)), plain_pav(rising))


# ---- sparse vectors ----


def texts(n=300):
    r = random.Random(4)
    pool = [f"w{i}" for i in range(60)]
    return [(i, " ".join(r.choice(pool[: r.choice([5, 20, 60])]) for _ in range(r.choice([3, 20, 60])))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "A b c")]


@pytest.mark.parametrize("tracked", [sparse.TRACKED, 8])
def test_vocabulary_is_complete(spark, tracked):
    """With summaries far too small the proof fails until they have grown; the terms are the same."""
    df = spark.createDataFrame(texts(), "id long, text string").repartition(3)
    _, vocabulary = sparse.fit(df, "id", "text", 100, tracked=tracked)
    tf = Counter()
    for _, t in texts():
        w = [x for x in (t or "").lower().split() if len(x) > 1] if (t or "").strip() else sparse.BLANK.split()
        tf.update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    most = sorted(tf, key=lambda t: (-tf[t], t))[:100]
    assert [r.term for r in vocabulary.orderBy("id").collect()] == most


def test_summaries_keep_their_bound(spark):
    df = spark.createDataFrame(texts(), "id long, text string").repartition(4)
    said = sparse._texts(df, "id", "text", None)
    exact = {r.term: r.n for r in sparse.counted(df, "id", "text").groupBy("term").agg(F.sum("tf").alias("n")).collect()}
    terms, bound = sparse.frequent(said, (1, 2), 50, 20)
    kept = {r.term for r in terms.collect()}
    assert all(n <= bound for t, n in exact.items() if t not in kept)


@pytest.mark.parametrize("size,descending,group", [(4, False, None), (64, True, None), (7, False, "page")])
def test_top_k_over_blocks(spark, size, descending, group):
    df = spark.createDataFrame(texts(), "id long, text string")
    v = sparse.fit(df, "id", "text", 200)[0].withColumn("page", F.col("doc") % 9)
    q = v.filter("doc % 7 = 0").select(F.col("doc").alias("query_id"), "ids", "ws")
    found = sparse.queries_top_k(sparse.build_index(v, group, size), q, 5, descending, 2).collect()
    rows = {r.doc: dict(zip(r.ids, r.ws)) for r in v.collect()}
    for i in (r.query_id for r in q.collect()):
        score = {d: round(sum(w * x.get(t, 0.0) for t, w in rows[i].items()), 12) for d, x in rows.items()}
        order = sorted((d for d in score if score[d] > 0), key=lambda d: (-score[d], -d if descending else d))
        seen, want = set(), []
        for d in order:
            if not group or d % 9 not in seen:
                seen.add(d % 9)
                want.append(d)
        assert [r.doc for r in sorted((r for r in found if r.query_id == i), key=lambda r: r.rank)] == want[:5]


def test_top_k_skips_blocks(spark):
    """Two languages without common words: a query reads the postings of its own only."""
    rows = [(i, f"w{i % 7} v{i % 11} u{i % 5}" if i % 2 else f"x{i % 7} y{i % 11} z{i % 5}") for i in range(600)]
    v = sparse.fit(spark.createDataFrame(rows, "id long, text string"), "id", "text", 200)[0]
    found = sparse.queries_top_k(sparse.build_index(v, size=8), v.filter("doc < 4").select(F.col("doc").alias("query_id"), "ids", "ws"), 3, first=1)
    read, postings = found.agg(F.sum("read")).first()[0], v.agg(F.sum(F.size("ids"))).first()[0]
    assert 0 < read < postings


# ---- dense vectors ----


def test_recall_of_cells(spark, sf):
    for name in (sf, "/root/testdata/sf0.01"):
        e = spark.read.parquet(f"{name}/embeddings.parquet")
        q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
        index = ann.build(e)
        assert index.table.count() == e.count()
        for where, k in ((None, 10), ("label = 2", 5)):
            exact = rows_of(vectors.dense_top_k(e, q, k, where and F.expr(where)), "query_id", "vec_id")
            near = rows_of(ann.search(index, e, q, k, where), "query_id", "vec_id")
            assert (exact & near).total() >= 0.9 * exact.total() and near.total() == exact.total()


def test_cells_of_odd_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, None), (3, 0, [0.0, 0.0]), (4, None, [0.0, 2.0]), (5, 0, [1.0, 0.1])]
    e = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, q array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.search(ann.build(e), e, q, 2).orderBy("rank").collect()] == [(1, 1), (1, 5)]
    assert ann.search(ann.build(e.filter("false")), e.filter("false"), q, 2).count() == 0


def test_principal_components(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = np.array([r.embedding for r in e.orderBy("vec_id").collect()], float)
    x -= x.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    got = vectors.pca_2d(e).orderBy("vec_id").collect()
    for k, c in enumerate(("x", "y")):
        mine, want = np.array([r[c] for r in got]), u[:, k] * s[k]
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        assert got[0][f"{c}_share"] == pytest.approx(s[k] ** 2 / (s**2).sum())


# ---- reviews ----

INCIDENTS = "incident_id string, asset_key string, family string"


def test_rerun_archives_every_vanished_review(spark):
    """Decided, pending and archived reviews whose findings are there, cleared or gone."""
    old = spark.createDataFrame([("r1", "a", "approved", "pothole", False, "{}"), ("r2", "b", "pending", None, False, "{}"), ("r3", "gone1", "rejected", None, False, "{}"), ("r4", "gone2", "pending", "pothole", False, "{}"), ("r5", "gone3", "approved", None, True, '{"kept":1}'), ("r6", "back", "approved", None, True, '{"kept":2}')], "review_id string, incident_id string, decision string, edited_family string, archived boolean, snapshot string")
    was = spark.createDataFrame([(i, f"PUMP:{i}", "unknown") for i in ("a", "b", "gone1", "gone2")], INCIDENTS)
    f = was.select("incident_id", F.concat(F.lit("T "), "incident_id").alias("title"), "family")
    new = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("back", False)], "incident_id string, needs_review boolean")
    got = {r.incident_id: r for r in reviews.carry_reviews(old, was, f, new).collect()}
    assert {i: (r.decision, r.archived) for i, r in got.items()} == {"a": ("approved", False), "c": ("pending", False), "gone1": ("rejected", True), "gone2": ("pending", True), "gone3": ("approved", True), "back": ("approved", False)}
    assert got["a"].edited_family == "pothole" and got["a"].snapshot == "{}" and got["c"].review_id == "R-c"
    for i in ("gone1", "gone2"):
        s = json.loads(got[i].snapshot)
        assert s["incident"]["asset_key"] == f"PUMP:{i}" and s["insight"]["title"] == f"T {i}"
    assert got["gone3"].snapshot == '{"kept":1}'


def test_family_edits_reach_incidents_and_are_restored(spark):
    r = reviews.complete_columns(spark.createDataFrame([("r1", "a", "pending"), ("r2", "b", "pending")], "review_id string, incident_id string, decision string"))
    i = spark.createDataFrame([("a", "A", "unknown"), ("b", "B", "water_leak")], INCIDENTS)
    f = i.select("incident_id", "family")
    entry = lambda *rows: spark.createDataFrame(rows, "review_id string, decision string, edited_family string, sets_family boolean, decided_at string").withColumn("decided_at", F.col("decided_at").cast("timestamp"))
    edited = reviews.apply_decisions(r, entry(("r1", "approved", "pothole", True, "2024-01-01")))
    i1 = reviews.with_edited_families(i, f, edited)
    assert rows_of(i1, "incident_id", "family") == Counter([("a", "pothole"), ("b", "water_leak")])
    silent = reviews.apply_decisions(edited, entry(("r1", "rejected", None, False, "2024-01-02")))
    assert rows_of(reviews.with_edited_families(i1, f, silent), "family") == Counter([("pothole",), ("water_leak",)])
    back = reviews.apply_decisions(silent, entry(("r1", "approved", None, True, "2024-01-03")))
    assert rows_of(reviews.with_edited_families(i1, f, back), "family") == Counter([("unknown",), ("water_leak",)])
    shut = back.withColumn("archived", F.lit(True))
    assert rows_of(reviews.apply_decisions(shut, entry(("r1", "rejected", None, False, "2024-01-04"))), "review_id", "decision") == Counter([("r1", "approved"), ("r2", "pending")])


def test_review_store_rewrites_touched_buckets(spark, tmp_path):
    s = ReviewStore(spark, str(tmp_path / "reviews"), 8)
    s.merge(spark.range(100).select(F.col("id").cast("string").alias("review_id"), F.lit("pending").alias("decision")))
    before = s.state()[1]["buckets"]
    touched = s.merge(spark.createDataFrame([("7", "approved"), ("new", "pending")], "review_id string, decision string"), spark.createDataFrame([("9",)], "review_id string"))
    after = s.state()[1]["buckets"]
    assert len(touched) <= 3 and {b for b in before if before[b] != after.get(b)} == {str(b) for b in touched}
    got = {r.review_id: r.decision for r in s.read().collect()}
    assert len(got) == 100 and got["7"] == "approved" and "new" in got and "9" not in got
    with pytest.raises(RuntimeError):
        s.merge(s.read().limit(1), after=1)


def test_two_writers(spark, tmp_path):
    """Both start from one generation: the second to finish fails and leaves nothing to read."""
    root = str(tmp_path / "store")
    tables.publish_snapshot(spark, root, {"t": spark.range(1)}, "zero")
    after = tables.current(spark, root)[0]
    tables.publish_snapshot(spark, root, {"t": spark.range(2)}, "one", after)
    with pytest.raises(RuntimeError):
        tables.publish_snapshot(spark, root, {"t": spark.range(3)}, "two", after)
    assert tables.current_run(spark, root) == "one" and tables.read_snapshot(spark, root, "t").count() == 2
    assert len(list((tmp_path / "store" / "runs").iterdir())) == 2
    # a claim that holds nothing is passed over
    (tmp_path / "store" / "_GENERATIONS" / f"{after + 2:012d}").write_text("")
    assert tables.current_run(spark, root) == "one"


# ---- manifests, counters ----


def test_manifest_names_the_range(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 3).cast("string").alias("v")).unionByName(spark.createDataFrame([(None, "x")], "k long, v string"))
    manifest.write_manifest(df, f"{tmp_path}/m", "k", 10, 4)
    assert manifest.differing_ranges(df.repartition(5), f"{tmp_path}/m").count() == 0
    changed = df.withColumn("v", F.when(F.col("k") == 123, "other").otherwise(F.col("v"))).filter("k IS NULL OR k <> 987")
    assert rows_of(manifest.differing_ranges(changed, f"{tmp_path}/m"), "first", "past", "stored_rows", "rows") == Counter([(120, 130, 10, 10), (980, 990, 10, 9)])
    own = manifest.dataset_id(spark, {"t": f"{tmp_path}/m"})
    good = {"score_space": "raw", "provenance": "human", "dataset_id": own}
    assert manifest.trusted_calibration(good, {"t": df}, {"t": f"{tmp_path}/m"}) == own
    for artifact, data in ((good, changed), (good | {"dataset_id": "of other data"}, df), (good | {"dataset_id": None}, df)):
        with pytest.raises(ValueError):
            manifest.trusted_calibration(artifact, {"t": data}, {"t": f"{tmp_path}/m"})
    manifest.write_manifest(df.limit(0), f"{tmp_path}/none", "k", 10)


def test_counters_count_as_they_are_written(spark, tmp_path):
    seen = normalize.Counters()
    seen.watch(spark.range(10), "t", source=F.lit(True), odd=F.col("id") % 2 == 1).write.parquet(f"{tmp_path}/t")
    assert seen.counts() == {("t", "source"): 10, ("t", "odd"): 5}


# ---- search ----


def test_searches(spark):
    said = ["recurring sewer backups", "recurring streetlights out in 2023", "more than 1 thing", "nothing of the kind", "more than 99999999999", None]
    s = search.parse(spark.createDataFrame(list(enumerate(said)), "id int, q string"), "id", "q")
    got = {r.query_id: r for r in s.collect()}
    assert [got[i].family for i in range(6)] == ["sewer_backup", "electrical_issue", None, None, None, None]
    assert got[1].year == 2023 and got[0].recurring and got[2].more_than == 1 and got[4].more_than is None and got[5].terms == []
    i = spark.createDataFrame([("i1", "A", "sewer_backup", "2022-01-01", True), ("i2", "A", "sewer_backup", "2023-01-01", False), ("i3", "B", "electrical_issue", "2023-05-01", True), ("i4", "B", "electrical_issue", "2022-05-01", True)], "incident_id string, asset_key string, family string, d string, recurring boolean").withColumn("first_seen", F.col("d").cast("timestamp"))
    assert rows_of(search.matching_assets(s, i), "query_id", "asset_key", "matching_incidents") == Counter([(0, "A", 1), (1, "B", 1), (2, "A", 2), (2, "B", 2)])
    assert rows_of(search.matching_incidents(s, i, 3), "query_id", "incident_id") == Counter([(0, "i1"), (1, "i3"), (2, "i1"), (2, "i2"), (2, "i3")])


def test_a_page_is_cited_once(spark):
    chunks = spark.createDataFrame([("m", 1, 0, "flush the water main"), ("m", 1, 1, "flush the water main again"), ("m", 2, 0, "water samples"), ("n", 1, 0, "no match here")], "source string, page long, chunk_no int, chunk string")
    q = spark.createDataFrame([(1, "how to flush the water main"), (2, "zzz")], "id int, q string")
    got = search.cited_chunks(q, chunks, "id", "q", "source", "page").orderBy("rank").collect()
    assert [(r.query_id, r.source, r.page) for r in got][:2] == [(1, "m", 1), (1, "m", 2)] and got[0].citation == "[m p.1]"
    assert len({(r.source, r.page) for r in got}) == len(got)
