"""Operators on small inline rows, with the expected results of the inventory's fixtures."""

import random
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline import constants as K
from faultline import queries as Q
from faultline.functions import classify as C
from faultline.functions import text as X
from faultline.functions import values as V
from faultline.operators import calibration, features, grouping, insight, normalize, pairs, registers, scoring, search, sparse, vectors
from faultline.sources import tables

T0 = datetime(2024, 1, 1)
X_WORDS = re.compile(r"\b(\w\w+)\b")


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_identifiers_and_keys(spark):
    assert [one(spark, v, V.valid_identifier) for v in (None, "", " NaN ", "0", "7")] == [False, False, False, False, True]
    assert one(spark, "0", lambda c: V.valid_identifier(c, True))
    assert one(spark, " water  main ", lambda c: V.asset_key(c, F.lit(" a1 "))) == "WATER_MAIN:A1"
    assert one(spark, "pump_station", V.asset_class) == "equipment" and one(spark, "CITY_DEPTS", V.asset_class) == "location"
    assert [one(spark, v, V.tri_state) for v in ("Yes", "0", "maybe", None)] == [True, False, None, None]


@pytest.mark.parametrize("text,want", [("2024-03-02T10:00:00Z", datetime(2024, 3, 2, 10)), ("3/2/2024 10:05", datetime(2024, 3, 2, 10, 5)), ("03/02/2024", datetime(2024, 3, 2)), ("2024/03/02", datetime(2024, 3, 2)), ("1970-01-01", None), ("2222-01-01", None), ("nope", None), (None, None)])
def test_timestamps(spark, text, want):
    assert one(spark, text, lambda c: V.parse_timestamp(c, F.lit("2025-01-01").cast("timestamp"))) == want


def test_alias_resolution(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "NULL")], "WORK_ORDER_ID string, Created_Date string, PRIORITY string")
    assert tables.with_canonical_columns(df, "work_orders").select("work_order_id", "date", "priority").first() == ("1", "2024-01-01", None)
    with pytest.raises(ValueError):
        tables.with_canonical_columns(df.drop("WORK_ORDER_ID"), "work_orders")
    with pytest.raises(ValueError):
        tables.gate_import({"work_orders": df})


def test_cleaning(spark):
    assert one(spark, "Pump replaced today. Pump replaced today! Status changed to closed", X.clean_note) == "Pump replaced today."
    assert one(spark, "From: Request ID: 7 x Problem Details: valve leaking badly", X.clean_note) == "valve leaking badly"
    assert [one(spark, v, X.clean_note) for v in (None, "ok", "System: closed by job", "work order closed.", "short")] == ["", "", "", "", ""]
    assert not one(spark, "picked up supply order", X.is_maintenance) and one(spark, "valve replaced", X.is_maintenance)


def test_redaction(spark):
    r = one(spark, "Call 555-123-4567 or a.b@c.org, badge #12345, contact Jane Doe", X.redact_pii)
    assert r.was_redacted and r.kinds == ["EMAIL", "PHONE", "EMPLOYEE_ID", "PERSON_NAME"] and "Jane" not in r.text
    street = "Leak at 123 North Main Street near valve"
    assert one(spark, street, X.redact_pii).text == street and "[ADDRESS_REDACTED]" in one(spark, street, X.redact_external).text
    df = spark.createDataFrame([("mail me at a@b.org", ["X1"]), ("asset X1 fine", ["X1"])], "t string, ids array<string>")
    safe, held = X.screen(df, "t", "ids")
    assert safe.count() == held.count() == 1


@pytest.mark.parametrize("text,want", [("Unit running but not cooling.", "UNRESOLVED"), ("Patching completed.", "REPAIR_RECORDED"), ("No problem found.", "NO_ISSUE_OBSERVED"), ("Returned to service", "RESOLVED"), ("hello", "UNKNOWN"), (None, "UNKNOWN")])
def test_resolution(spark, text, want):
    assert one(spark, text, X.resolution_signal) == want


def test_direct_cause(spark):
    assert one(spark, ["Leak was not due to valve failure."], X.direct_cause, "array<string>") is None
    assert one(spark, ["Checked. Outage caused by tree. x"], X.direct_cause, "array<string>") == "Outage caused by tree."


def test_chunks(spark):
    n = {k: X.chunks(spark.createDataFrame([("a" * k,)], "text string")).count() for k in (39, 40, 900, 901, 1650, 1651)}
    assert n == {39: 0, 40: 1, 900: 1, 901: 2, 1650: 2, 1651: 3}
    assert one(spark, "a–b…é“q”", X.to_ascii) == 'a-b... "q"'


@pytest.mark.parametrize("text,want", [("busted water line", "main_break"), ("street light keeps flickering", "electrical_issue"), ("air conditioner is blowing warm air", "hvac_failure"), ("pothole and pothole on road", "pothole"), ("nothing here", "unknown")])
def test_classification(spark, text, want):
    assert C.classify(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").first().family == want


def test_normalisation(spark):
    w = spark.createDataFrame([("1", "2024-01-01", "b"), ("1", "2024-02-01", "c"), ("", "2024-01-01", "d"), ("2", "bad", "e")], "WorkOrderId string, CreatedDate string, Priority string")
    out = normalize.normalize_work_orders(tables.with_canonical_columns(w, "work_orders").coalesce(1), "2025-01-01").collect()
    assert [(r.work_order_id, r.priority, r.department) for r in out] == [("1", "b", "unknown")]
    raw = [("1", "PUMP", "20", "primary"), ("1", "ADDRESSES", "5", "attached"), ("1", "PUMP", "20", "attached")] + [("9", "P", str(i), "primary") for i in range(11)]
    li = normalize.link_candidates(spark.createDataFrame(raw, "work_order_id string, entity_type string, entity_uid string, role string").coalesce(1))
    assert {(r.work_order_id, r.asset_key, r.role) for r in li.collect()} == {("1", "PUMP:20", "primary"), ("1", "ADDRESSES:5", "attached")}
    assert [r.asset_key for r in normalize.anchors(li).collect()] == ["PUMP:20"]
    c = spark.createDataFrame([("20", "1", "second note here. ok then"), ("3", "1", "first note about the valve")], "comment_id string, work_order_id string, text string")
    nested = normalize.nest(spark.createDataFrame([("1",)], "work_order_id string"), li, normalize.normalize_comments(c)).first()
    assert nested.cleaned_notes[0].startswith("first") and nested.eligibility == "eligible"


def orders(spark, rows):
    """(id, day, asset list, family)"""
    data = [(i, T0 + timedelta(days=d), a, a, f, "D", "UNKNOWN") for i, d, a, f in rows]
    return spark.createDataFrame(data, "work_order_id string, occurred_at timestamp, primary_asset_keys array<string>, asset_keys array<string>, family string, department string, signal string")


def edge_table(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, weight double")


def test_span_bound(spark):
    o = orders(spark, [("1", 0, ["P:1"], "water_leak"), ("2", 121, ["P:1"], "water_leak"), ("3", 244, ["P:1"], "water_leak")])
    g = grouping.constrained_groups(edge_table(spark, [("1", "2", 0.9), ("2", "3", 0.8)]), o).collect()
    assert sorted(sum(r.group == k for r in g) for k in {r.group for r in g}) == [1, 2]


def test_bridge_needs_a_common_anchor(spark):
    o = orders(spark, [("1", 0, ["P:1"], "unknown"), ("2", 1, ["P:1", "P:2"], "unknown"), ("3", 2, ["P:2"], "unknown")])
    g = grouping.constrained_groups(edge_table(spark, [("1", "2", 0.9), ("2", "3", 0.9)]), o).collect()
    assert sorted(sum(r.group == k for r in g) for k in {r.group for r in g}) == [1, 2]


def test_groups_match_a_naive_walk(spark):
    r = random.Random(6)
    rows = [(f"{i:02d}", r.randint(0, 250), r.sample(["P:1", "P:2", "P:3"], r.randint(1, 2)), r.choice(["a", "unknown"])) for i in range(40)]
    es = [(f"{a:02d}", f"{b:02d}", round(r.random(), 2)) for a, b in {tuple(sorted(r.sample(range(40), 2))) for _ in range(60)}]
    info = {i: [d, d, set(a)] for i, d, a, _ in rows}
    root = {i: i for i in info}
    for s, t, _ in sorted(es, key=lambda e: (-e[2], e[0], e[1])):
        a, b = root[s], root[t]
        x, y = info[a], info[b]
        if a != b and x[2] & y[2] and max(x[1], y[1]) - min(x[0], y[0]) <= 180:
            info[a] = [min(x[0], y[0]), max(x[1], y[1]), x[2] & y[2]]
            root = {k: a if v == b else v for k, v in root.items()}
    got = grouping.constrained_groups(edge_table(spark, es), orders(spark, rows)).collect()
    as_sets = lambda pairs: {frozenset(k for k, v in pairs if v == g) for g in {v for _, v in pairs}}
    assert as_sets([(x.work_order_id, x.group) for x in got]) == as_sets(list(root.items()))


def test_incidents(spark):
    o = orders(spark, [("1", 0, ["P:1"], "unknown"), ("2", 31, ["P:1"], "a"), ("3", 61, ["P:1"], "a")])
    i = grouping.build_incidents(spark.createDataFrame([(k, "g") for k in "123"], "work_order_id string, group string"), o).first()
    import hashlib

    assert i.incident_id == "INC-" + hashlib.sha1(b"1|2|3").hexdigest()[:8].upper() and i.family == "a" and not i.recurring and i.asset_key == "P:1"


def test_edge_scores(spark):
    o = orders(spark, [("1", 0, ["P:1"], "unknown"), ("2", 1 / 24, ["P:1"], "unknown")])
    e = pairs.score_edges(spark.createDataFrame([("1", "2", 0.5)], "source string, target string, semantic double"), o).first()
    assert e.days_apart == 0 and e.temporal_score == pytest.approx(1 - (1 / 24) / 365) and e.same_asset and not e.same_issue_family
    many = orders(spark, [(f"{i:02d}", i, [f"P:{i}"], "a") for i in range(40)])
    p = pairs.candidate_pairs(many).collect()
    assert len(p) < 780 and all(x.source < x.target for x in p) and len(set(p)) == len(p)


def test_episode_gap_is_exact(spark):
    rows = spark.createDataFrame([("a", str(i), T0 + timedelta(days=d)) for i, d in enumerate((0, 180, 361, 400, 410))], "asset_key string, work_order_id string, occurred_at timestamp")
    assert [(r.jobs, r.span_days) for r in grouping.gap_episodes(rows, least=1).orderBy("started").collect()] == [(2, 180), (3, 49)]


def test_context_and_features(spark):
    rows = spark.createDataFrame([("P", "1", T0, "a", True, False), ("P", "2", T0 + timedelta(days=3), "unknown", False, True), ("P", "3", T0 + timedelta(days=3), "b", False, False)], "asset_key string, work_order_id string, occurred_at timestamp, family string, repair boolean, follow_up boolean")
    got = {r.work_order_id: r for r in features.propagate_context(rows).collect()}
    assert got["2"].family == "b" and got["2"].method == "sequence_context" and got["1"].method is None
    f = {r.work_order_id: r for r in features.temporal_features(rows).collect()}
    assert (f["1"].jobs_30d, f["2"].jobs_30d, f["3"].jobs_30d) == (0, 1, 2) and f["3"].days_since_previous == 0


def test_calibration_and_brier(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.2, 0), (0.6, 0)], "score double, label int")
    b = calibration.brier(rows).first()
    assert b.brier == pytest.approx(0.1125) and b.accuracy == 0.75
    t = calibration.thresholds(spark.createDataFrame([(0.9, 1), (0.8, 0), (0.4, 1)], "score double, label int"), (0.8,)).first()
    assert (t.accepted, t.precision, t.review_load) == (2, 0.5, 1) and t.coverage == pytest.approx(0.666667, abs=1e-6)
    bins = calibration.bins(spark.createDataFrame([(0.0, 0), (0.45, 1), (1.0, 1)], "score double, label int"), 5).orderBy("bin").collect()
    assert sum(x.n for x in bins) == 3 and bins[-1].mean_score == 1.0
    art = calibration.fit_isotonic(rows)
    assert calibration.artifact_violations(art).isEmpty()
    a = art.first()
    step = lambda s: one(spark, s, lambda c: scoring.calibrated(c, F.array(*map(F.lit, a.x_values)), F.array(*map(F.lit, a.y_values))), "double")
    assert step(0.0) == 0 and step(1.0) == 1
    with pytest.raises(ValueError):
        scoring.guard_calibration(None, operational=True)


def test_risk(spark):
    e = spark.createDataFrame([("P", str(i), T0 + timedelta(days=i), "a", "High") for i in range(5)], "asset_key string, work_order_id string, occurred_at timestamp, family string, priority string")
    s = spark.createDataFrame([("P", "i", "UNRESOLVED")], "asset_key string, incident_id string, resolution_status string")
    assert scoring.asset_risk(e, s).first().risk == round(25 * 5 / 8 + 30 + 15 + 5 + 15)


def findings(spark, days):
    m = spark.createDataFrame([("INC-1", str(i), T0 + timedelta(days=d), "water_leak", False, "UNKNOWN", ["note"], ["Leak due to age. ok"] if i == 1 else ["note"], ["P:1"]) for i, d in enumerate(days, 1)], "incident_id string, work_order_id string, occurred_at timestamp, family string, repair boolean, signal string, cleaned array<string>, redacted array<string>, assets array<string>")
    i = spark.createDataFrame([("INC-1", "P:1", "water_leak", len(days) >= 3, T0, T0, "UNKNOWN")], "incident_id string, asset_key string, family string, recurring boolean, first_seen timestamp, last_seen timestamp, resolution_status string")
    return insight.generate_insights(i, m, tables.rules_table(spark)), m


def test_interval_and_citations(spark):
    f, m = findings(spark, (0, 31, 61))
    r = f.first()
    assert r.pm_interval_recommendation.status == "RECOMMENDED" and r.pm_interval_recommendation.interval_days == 30.5
    assert r.possible_cause.support_level == "SUPPORTED" and r.possible_cause.evidence == ["1"]
    assert insight.citation_violations(f, m).isEmpty()
    assert not insight.citation_violations(f, m.filter("work_order_id <> '2'")).isEmpty()
    single, _ = findings(spark, (0,))
    assert single.first().pm_interval_recommendation.status == "INSUFFICIENT_EVIDENCE" and single.first().pm_interval_recommendation.abstention_reason


def test_stop_words_alone_give_no_phrases(spark):
    df = spark.createDataFrame([(i, "the and of with this") for i in range(4)], "id int, text string")
    assert vectors.phrases(df, "id", "text").count() == 0


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.range(3)
    first = tables.publish_snapshot(spark, root, {"t": df})
    assert tables.current_run(spark, root) == first and tables.read_snapshot(spark, root, "t").count() == 3
    second = tables.publish_snapshot(spark, root, {"t": df.limit(1)})
    assert tables.current_run(spark, root) == second and tables.read_snapshot(spark, root, "t").count() == 1


def test_rules_cover_families():
    assert {r[0] for r in K.RULES} == {*K.FAMILIES, K.UNKNOWN}


def test_searches_cover_the_query_set(spark, sf):
    """Every id that 50 divides has its own top-k over all rows, dense and by terms."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, labels = np.array([r.vec_id for r in e]), np.array([r.label for r in e])
    v = np.array([r.embedding for r in e], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)

    def best(pairs, k):
        return [d for _, d in sorted((-round(s, 9), d) for d, s in pairs)[:k]]

    for name, k, able in (("e4_dense_top_k_all", 10, labels >= -1), ("e8_filtered_search_all", 5, labels == 2)):
        got = {}
        for r in sorted(Q.QUERIES[name](spark, sf).collect(), key=lambda r: (-r.score, r.vec_id)):
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert set(got) == {int(i) for i in ids if i % 50 == 0} and len(got) > 3
        for i in np.flatnonzero(ids % 50 == 0):
            assert set(got[ids[i]]) == set(best(zip(ids[able].tolist(), v[able] @ v[i]), k))
    weights = {}
    for r in sparse.as_rows(*sparse.fit(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")).collect():
        weights.setdefault(r.doc, {})[r.term] = r.w
    got = {}
    for r in Q.QUERIES["e3_query_top_k_notes"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.doc)
    assert set(got) == {d for d in weights if d % 50 == 0}
    for d, found in got.items():
        scores = ((o, sum(w * weights[d].get(t, 0.0) for t, w in terms.items())) for o, terms in weights.items())
        assert found == set(best((x for x in scores if x[1] > 0), 10))


def test_phrases_are_those_of_the_notes(spark, sf):
    left_out = set(vectors.stop_words())
    notes = [" ".join(w for w in X_WORDS.findall((r.text or "").lower()) if w not in left_out) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = Q.QUERIES["c11_phrases"](spark, sf).collect()
    assert got and all(r.documents == sum(f" {r.term} " in f" {n} " for n in notes) for r in got)
    # no phrase of the vocabulary is lost: those found are the most frequent ones of at least two notes
    tf, df = Counter(), Counter()
    for n in notes:
        w = n.split(" ")
        own = Counter(" ".join(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1))
        tf.update(own)
        df.update(own.keys())
    most = sorted((t for t in tf if df[t] >= 2), key=lambda t: (-tf[t], t))[: vectors.PHRASES]
    assert {r.term for r in got} <= set(most)


def test_d4_reaches_every_method(spark, tmp_path):
    """The bench taxonomy over a fixture: keyword votes by brute force, and exemplars where no keyword counts."""
    texts = ["The station and the thing", "action", "moment que", "xyz", None, "", "THE END", "nothing to mention, que", "of the and to", "der und den", "das ein", "und das"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.key: r for r in Q.d4(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    assert [(got[i].family, got[i].method) for i in (9, 10)] == [("nouns", "tfidf"), ("neuters", "tfidf")] and got[11].method in ("tfidf", "below_family_margin")
    for i, t in enumerate(texts[:9]):
        low, best = (t or "").lower(), (0, None)
        able = [f for f, (_, _, p) in Q.BENCH.items() if re.search(p, low)]
        for f in able:
            n = sum(low.count(w) for w in Q.BENCH[f][0])
            best = (n, f) if n > best[0] else best
        assert got[i].method == ("exact_corpus_trigger" if able else "no_supported_family") and got[i].family == (best[1] or K.UNKNOWN)
    # keywords that don't occur leave the decision to the exemplars
    shelf = {"a": (("zzz",), ("red apple", "green apple"), "fruit"), "b": (("zzz",), ("red brick", "grey brick"), "fruit|stone")}
    notes = ["fruit apple", "stone brick", "fruit red", "fruit " + "apple " + " ".join(f"word{i}" for i in range(9)) + " red", "fruit", "other"]
    df = spark.createDataFrame(list(enumerate(notes)), "doc_id long, text string")
    found = {r.key: r for r in C.classify(df, "doc_id", "text", shelf).collect()}
    assert [found[i].method for i in (0, 1, 2, 4, 5)] == ["tfidf", "tfidf", "below_family_margin", "no_match", "no_supported_family"]
    assert (found[0].family, found[1].family, found[2].family) == ("a", "b", K.UNKNOWN)


def test_confidence_takes_the_edges_of_incidents(spark, sf):
    home = {r.work_order_id: r.incident_id for r in Q.members(spark, sf).select("work_order_id", "incident_id").collect()}
    by = {}
    for r in pairs.admitted(Q.edges(spark, sf)).select("source", "target", "semantic").collect():
        if home.get(r.source) is not None and home[r.source] == home.get(r.target):
            by.setdefault(home[r.source], []).append(r.semantic)
    got = {r.incident_id: r.semantic_consistency for r in Q.confidence(spark, sf).collect()}
    assert by and set(got) == set(home.values())
    for i, s in got.items():
        assert s == pytest.approx(np.mean(by[i]) if i in by else 0.40)
    assert any(abs(s - 0.40) > 0.01 for s in got.values())


def test_groups_by_rounds_equal_the_serial_walk(spark):
    """Random edges over jobs with several anchors: rounds of joins and the walk in one task give the same groups."""
    r = random.Random(9)
    jobs = [(f"{i:03d}", T0 + timedelta(hours=r.randint(0, 60)), [f"A{k}" for k in sorted(r.sample(range(4), r.randint(1, 3)))], r.choice(["x", "y", K.UNKNOWN])) for i in range(18)]
    orders = spark.createDataFrame([(i, t, a, a, f) for i, t, a, f in jobs], "work_order_id string, occurred_at timestamp, primary_asset_keys array<string>, asset_keys array<string>, family string")
    pairs_ = {tuple(sorted(r.sample([j[0] for j in jobs], 2))) for _ in range(30)}
    e = spark.createDataFrame([(a, b, round(r.random(), 1)) for a, b in sorted(pairs_)], "source string, target string, weight double")
    walk, rounds = ({x.work_order_id: x.group for x in grouping.constrained_groups(e, orders, 1.5, True, most).collect()} for most in (10_000, 0))
    assert walk == rounds and 3 < len(set(walk.values())) < 18


def test_first_sentences(spark):
    """The first of each key stays, in order; the same from plain Python over long notes."""
    said = ["Pump ran.", "pump RAN!", "...", "Valve shut.", "Pump ran?", "Seal wet."] + [f"Note {i % 50}." for i in range(400)]
    got = spark.createDataFrame([(said,), ([],), (None,)], "s array<string>").select(X.first_sentences(F.col("s")).alias("y")).collect()
    seen, want = set(), []
    for s in said:
        k = " ".join(re.sub(r"\W+", " ", s.lower()).split())
        if k and k not in seen:
            seen.add(k)
            want.append(s)
    assert [g.y for g in got] == [want, [], None]


def test_knn_blocks_match_brute_force(spark):
    """Blocks of any size, equal vectors, null ones and one of no length."""
    g = np.random.default_rng(6)
    x = g.normal(size=(60, 8))
    x[10] = x[11] = x[12]
    rows = [(i, int(i % 3), [float(v) for v in x[i]]) for i in range(60)] + [(70, 1, None), (71, 1, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    want = {}
    for i in range(60):
        near = sorted((j for j in range(60) if j != i), key=lambda j: (-s[i, j], j))[:5]
        want[i] = min(range(3), key=lambda c: (-sum(j % 3 == c for j in near), c))
    for block in (2000, 7):
        assert {r.vec_id: r.predicted for r in vectors.knn_classify(df, block=block).collect()} == want


def test_structured_report_and_refusals(spark):
    a = spark.createDataFrame([("raw", "human", "d"), ("x", "human", "d"), ("raw", "synthetic", "d"), (None, "human", "e")], "score_space string, provenance string, dataset_id string")
    assert [r.refused for r in scoring.refusals(a, True, "d").collect()] == [None, "score_space", "synthetic", "dataset"]
    assert [r.refused for r in scoring.refusals(a, False).collect()] == [None, "score_space", None, None]
    log = spark.createDataFrame([("R", "call a.b@c.org", None)], "review_id string, reviewer_note string, edited_action string")
    assert registers.store_decisions(log).first() == ("R", "call [EMAIL_REDACTED]", None)
    q = search.parse(spark.createDataFrame([(1, "Recurring leaks, more than 3 in 2021"), (2, None)], "id int, q string"), "id", "q", None).orderBy("query_id").collect()
    assert (q[0].year, q[0].more_than, q[0].recurring, q[0].terms) == (2021, 3, True, ["leaks", "more", "recurring", "than"]) and (q[1].year, q[1].recurring, q[1].terms) == (None, False, [])
