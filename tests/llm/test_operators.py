"""Each corpus operator against a brute-force version on a small table full of edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from faultline.llm import components as cc
from faultline.llm import exact_dedup, language_id, mixing, ngram_join, packing, quality, range_coder, suffix_dedup, token_file, url_filter, warc
from faultline.llm.shared import new_path
from faultline.llm.tokens import default_path, encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdeghilnorst", k=r.randint(2, 9))) for _ in range(n))


def rows():
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows, shared passages."""
    a, b, passage = words(1, 120), words(2, 300), words(3, 110)
    near = a.split()
    near[60] = "changed"
    out = [
        (1, a, "en", "src1", 10), (2, a, "en", None, 10), (3, " ".join(near), "en", "src0", None), (4, b, "fr", "src2", 3), (5, None, "en", "src3", 0), (6, "", None, "src0", 0),
        (7, "   \n\t ", "de", "src0", 5), (8, b + " end", "fr", "src2", 3), (9, words(9, 60) + passage + words(10, 40), "en", "src4", 1), (10, words(11, 45) + passage + words(12, 70), "en", "src5", 1),
        (11, "x" * 1500, "es", "src6", 2), (12, (words(13, 50) + "\n") * 30, "en", "src7", 2), (13, "Été — naïve 東京 12½ <|endoftext|> \x1c ok", "fr", "src8", 2), (14, words(14, 9000), "de", "src9", 9),
        (15, "one two", "en", "src1", 2), (16, "ONE two", "en", "src1", 2), (17, a, "en", "src1", 10), (17, a, "en", "src1", 10), (None, "no id here", "en", "src1", 3),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Extra columns under names that operators use inside."""
    for name in ("key", "body", "rep", "n", "cluster", "node", "lang_pred", "score", "weight", "tokens", "kept", "unit", "digit", "row", "id", "copy", "sha", "own_sha", "least_id", "mix_tokens", "mix_weight", "mix_source", "mix_copies", "lang_score", "fold", "prefix", "held", "record", "template", "purity"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


# ---- 10: exact dedup ----


def test_exact_duplicates_of_long_texts(spark):
    """Two texts of 3 MB, and one that differs in its last byte: as many rounds as the logarithm of the length."""
    a, b = "long text " * 300_000, "long text " * 299_999 + "long texT "
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(df).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


@pytest.mark.parametrize("digits", [exact_dedup.DIGITS, (1, 2, 97, 30_000)])
def test_exact_duplicates(docs, digits):
    got = exact_dedup.exact_duplicates(clashing(docs), digits=digits).collect()
    by = defaultdict(list)
    for d, t, *_ in rows():
        by[t or ""].append(d)
    want = []
    for d, t, *_ in rows():
        ids = by[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_exact_duplicates_empty(empty):
    assert exact_dedup.exact_duplicates(empty).collect() == []
    assert exact_dedup.drop_exact_duplicates(empty).columns == empty.columns


def test_drop_exact_duplicates_keeps_columns(docs):
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, None}


def test_drop_exact_duplicates_keeps_one_of_each(spark):
    """Ids with two texts, repeated rows, rows without an id; texts that differ only past the first digit."""
    long = "x" * 500
    rows = [(1, "a"), (2, "a"), (1, "b"), (5, "r"), (5, "r"), (None, "n"), (None, "n"), (3, ""), (9, None), (7, long + "a"), (7, long + "b"), (8, long + "b")]
    df = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, own_sha string, row long")
    got = exact_dedup.drop_exact_duplicates(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, "a"), (1, "b"), (5, "r"), (None, "n"), (9, None), (7, long + "a"), (8, long + "b")], key=str)


# ---- 1: mixing ----


def test_raking_meets_margins(spark):
    cells = spark.createDataFrame([(s, la, t, 100 + 37 * i) for i, (s, la, t) in enumerate((s, la, t) for s in ("a", "b", "other") for la in ("x", "y") for t in ("p", "q"))], "source string, lang string, topic string, tokens long")
    aims = {"source": {"a": 0.7, "b": 0.3}, "lang": {"x": 0.2, "y": 0.8}, "topic": {"p": 0.5, "q": 0.5}}
    out = mixing.calibrate(mixing.rake(cells, aims, 30), 0.5).collect()
    for c, shares in aims.items():
        got = defaultdict(float)
        for r in out:
            got[r[c]] += r.weight
        for k, v in shares.items():
            assert got[k] == pytest.approx(v, abs=1e-6)
    assert sum(r.weight for r in out) == pytest.approx(1)
    expected = sum(r.tokens * r.probability for r in out)
    reach = sum(r.tokens for r in out if r.weight > 0)
    assert expected == pytest.approx(min(reach, 0.5 * sum(r.tokens for r in out)), rel=1e-6)
    assert all(0 <= r.probability <= 1 for r in out)


def test_taken_rows_meet_targets(spark):
    """A source with far too few tokens for its target: the rows taken, with their copies, have the shares aimed at."""
    rows = [(i, f"text {i} of its own", ("fr", "en")[i % 3 > 0], "src0" if i % 20 == 0 else f"src{i % 19 + 1}", 1) for i in range(6000)]
    df = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix_sources(df).collect()
    for c, raw in mixing.TARGETS.items():
        expected, taken, raked = Counter(), Counter(), {}
        for r in mixed:
            k = r[f"mix_{c}"]
            expected[k] += r.mix_tokens * r.mix_rate
            taken[k] += r.mix_tokens * r.mix_copies
        aims = {k: v / sum(raw[x] for x in expected) for k, v in raw.items() if k in expected}
        for k, v in aims.items():
            assert expected[k] / expected.total() == pytest.approx(v, abs=1e-6)
            assert taken[k] / taken.total() == pytest.approx(v, abs=0.01)
    assert all(r.mix_sampled == (r.mix_copies > 0) for r in mixed) and max(r.mix_copies for r in mixed) > 1
    kept = Counter(r.doc_id for r in mixing.keep_sampled(df).collect())
    assert kept == {r.doc_id: r.mix_copies for r in mixed if r.mix_copies}


def test_margins_are_reported(spark, sf):
    """Every margin of the rows taken is within a point of its target; a target without tokens shows as such."""
    mixed = mixing.mix_sources(spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet"), keep_other=True)
    got = mixing.margins(mixed).collect()
    assert {(r.margin, r.category) for r in got} >= {(m, k) for m, shares in mixing.TARGETS.items() for k in shares}
    for m in mixing.TARGETS:
        met = sum(r.target for r in got if r.margin == m and r.have)
        for r in got:
            if r.margin == m:
                assert r.expected == pytest.approx(r.target / met if r.have else 0, abs=1e-4)
                assert r.taken == pytest.approx(r.expected, abs=0.01)


def test_unlisted_categories_keep_rows(spark, tmp_path):
    """Null and unlisted sources and languages are sampled like the rest, in op1 and in the pipeline's stage."""
    rows = [(i, f"text {i} of its own", (None, "it", "en", "fr", "de")[i % 5], (None, "src20", "src0", "src1", "src2", "src3", "src4")[i % 7], 1) for i in range(3500)]
    df = spark.createDataFrame(rows, DOCS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op1_mix_sources(spark, str(tmp_path)).collect()
    taken = mixing.mix_sources(df, keep_other=True).collect()
    assert {r.doc_id for r in got if r.sampled} == {r.doc_id for r in taken if r.mix_sampled} == {r.doc_id for r in mixing.keep_sampled(df).collect()}
    whole = sum(r.mix_tokens for r in taken)
    for c in ("source", "lang"):
        have = sum(r.mix_tokens for r in taken if r[f"mix_{c}"] == "other") / whole
        expected = sum(r.mix_tokens * r.mix_rate for r in taken if r[f"mix_{c}"] == "other") / sum(r.mix_tokens * r.mix_rate for r in taken)
        assert have > 0.2 and expected == pytest.approx(have, abs=1e-6)
    kept = {(rows[r.doc_id][2], rows[r.doc_id][3]) for r in got if r.sampled}
    assert {(None, None), (None, "src20"), ("it", None), ("it", "src20"), ("en", "src20"), (None, "src1")} <= kept


def test_all_unlisted_keeps_rows(spark):
    df = spark.createDataFrame([(i, "some text", None, None, 1) for i in range(500)], DOCS)
    assert 400 < mixing.keep_sampled(df).count() < 500


def test_mixing_edges(docs, empty):
    got = {r.doc_id: r for r in mixing.mix_sources(clashing(docs)).collect()}
    assert len(got) == 18 and got[2].mix_source == "other" and got[2].mix_probability == 0
    assert got[5].mix_tokens == 1 and got[13].mix_topic == "general"
    assert mixing.mix_sources(empty).collect() == [] and mixing.keep_sampled(empty).columns == empty.columns
    wide = clashing(docs)
    left = mixing.keep_sampled(wide)
    assert left.columns == wide.columns and {r.mix_weight for r in left.collect()} == {"x"}
    assert mixing.keep_sampled(docs).columns == docs.columns


# ---- 9: urls ----


def test_urls(spark):
    urls = ["http://A.example.net/en/1", "https://x.example.com/de/2?x=/de/", "http://b.org/fr/3#top", "http://net/", "http://net", "ftp://q.net?x", "no scheme", None, "", "http://h.com/en/5", "http://h.com/en/6/", "http://H.COM/a/b/c/d/e?q", "http://example.net/en", "http://notexample.net/en/1", "http://a.b?://c/", "http://h.com/en/5"]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    assert len(got) == len(urls)
    assert [got[i].rule for i in range(6)] == ["example.net/en/", "example.com/de/", "org/fr/", "net/", None, None]
    assert (got[0].host, got[0].path, got[0].verdict) == ("a.example.net", "/en/1", "allow")
    assert (got[6].host, got[6].path) == ("", "") == (got[7].host, got[7].path)
    assert got[11].host == "h.com" and got[11].path == got[11].template == "/a/b/c/d/e"
    assert got[12].rule == "net/" and got[13].rule == "net/" and got[14].host == "a.b" and got[9].verdict == got[15].verdict == "allow"


def test_impure_templates_are_rejected(spark):
    rows = [(i, f"http://h.bad.net/x/{i}") for i in range(50)] + [(i, f"http://s.com/good/{i}") for i in range(50, 90)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert all(r.verdict == ("block" if r.page_id < 50 else "allow") for r in got)
    # a host whose labelled examples are blocked under one template: unlabelled pages of that template go too
    mixed = {"good.org/": "allow", "h.com/ads/1": "block"}
    rows = [(i, f"http://h.com/ads/1{i:02d}") for i in range(20)] + [(30, "http://h.com/ads/999"), (31, "http://h.com/news/5")]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), mixed).collect()}
    # 20 of the host's 22 urls are known to be bad: its other branch inherits that
    assert got[30].rule is None and got[30].verdict == "block" and got[31].rule is None and got[31].verdict == "block"
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_unlabelled_branches_inherit_evidence(spark):
    """A branch without labels follows its labelled sibling in so far as that makes up the host; depth has no bound."""
    rules = {"good.org/": "allow", "bad.com/ads/": "block", "mixed.com/ads/": "block"}
    urls = [f"http://bad.com/ads/x{i}" for i in range(30)] + ["http://bad.com/shop/y"]
    urls += [f"http://mixed.com/ads/x{i}" for i in range(3)] + [f"http://mixed.com/shop/y{i}" for i in range(30)]
    urls += [f"http://good.org/{i}/a" for i in range(9)] + ["http://else.org/b"]
    deep = "/" + "/".join(f"s{i}" for i in "abcdefghij")
    urls += [f"http://deep.com{deep}/x", f"http://deep.com{deep}/y", f"http://deep.com{deep}/y/z"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: r for r in url_filter.judge_urls(df, rules).collect()}
    assert got["http://bad.com/shop/y"].rule is None and got["http://bad.com/shop/y"].verdict == "block"
    assert all(got[f"http://mixed.com/shop/y{i}"].verdict == "allow" for i in range(30)) and got["http://else.org/b"].verdict == "allow"
    assert got["http://mixed.com/shop/y1"].purity > got["http://else.org/b"].purity
    assert got[f"http://deep.com{deep}/x"].template == f"{deep}/x" and got[f"http://deep.com{deep}/y/z"].template == f"{deep}/y/z"


# ---- 2: WARC ----


@pytest.mark.parametrize("most", [warc.MOST_BROADCAST, 0])
def test_warc_round_trip(spark, most):
    big = "<p>" + words(5, 60_000) + "é</p>\r\n\r\nWARC/1.1\r\n"
    pages = [(1, "http://a/\n b", big), (2, None, big), (3, "http://c", None), (4, "http://d", "short"), (5, "http://e", "short"), (6, "http://f", "y" * 100), (9, "http://g", "y" * 100), (7, "http://h", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = new_path(spark, "warc")
    man = warc.write_warc(warc.chunk_table(clashing(df.repartition(3)), chunk=1000, most=most), folder)
    read = warc.read_warc(man, folder, chunk=777, payload=True).collect()
    body, last = defaultdict(bytes), {}
    for r in sorted(read, key=lambda r: (r.page_id, r.chunk_no)):
        body[r.page_id] += bytes(r.chunk)
        assert r.record_type == "revisit" or r.sha256_so_far == hashlib.sha256(body[r.page_id]).hexdigest()
        if r["last"]:
            last[r.page_id] = r
    assert man.agg({"records": "sum"}).first()[0] == len(pages)
    for i, _, html in pages:
        want = (html or "").encode()
        assert (last[i].payload_bytes, last[i].sha256_so_far) == (len(want), hashlib.sha256(want).hexdigest())
        assert body[i] == (want if last[i].record_type == "response" else b"")
    assert {i: r.refers_to for i, r in last.items() if r.record_type == "revisit"} == {2: 1, 9: 6}
    none = warc.write_warc(warc.chunk_table(df.limit(0)), folder)
    assert warc.read_warc(none, folder).collect() == []


# ---- 3: quality ----


def test_quality_counts(spark, docs, empty):
    flat = np.zeros(quality.BUCKETS)
    got = sorted((tuple(r) for r in quality.score_quality(clashing(docs), flat, 0.0).collect()), key=str)
    want = []
    for d, t, *_ in rows():
        t = t or ""
        ws = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        cover = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        failed = len(ws) < 50 or 100 * len(cover) > 50 * len(ws)
        want.append((d, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), failed, not failed, 0.0))
    assert got == sorted(want, key=str)
    assert quality.score_quality(empty, flat, 0.0).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not quality.fit_ratio(docs, quality.trusted_ids(labels)).any()


def test_quality_verdict(spark):
    vocabulary, r = words(1, 400).split(), random.Random(2)
    good = [" ".join(r.choices(vocabulary, k=80)) for _ in range(60)]
    bad = [" | ".join(words(100 + i, 80).upper().split()) for i in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i < 60 else 0, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    ids = quality.trusted_ids(labels)
    ratio = quality.fit_ratio(df, ids)
    kept = {r.doc_id: r.kept for r in quality.score_quality(df, ratio, quality.fit_threshold(df, ids, ratio)).collect()}
    assert not any(kept[i] for i in range(60, 80)) and all(kept[i] for i in range(60))


def test_quality_scores_by_brute_force(spark):
    """Every score and verdict from plain dictionaries: counts of hashed n-grams, folds left out, threshold."""
    texts = [words(900 + i % 7, 60 + i % 11) + " " + words(1000 + i, 8) for i in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 90, 2)], "doc_id long, quality int, toxic int")
    ids = quality.trusted_ids(labels)
    ratio = quality.fit_ratio(df, ids)
    threshold = quality.fit_threshold(df, ids, ratio)
    got = {r.doc_id: r for r in quality.score_quality(df, ratio, threshold).collect()}
    fold = {r.doc_id: r.f for r in df.select("doc_id", quality.fold_of(df.doc_id, quality.FOLDS).alias("f")).collect()}
    assert len(set(fold.values())) == quality.FOLDS
    trusted = [i for i in range(0, 90, 2) if i % 3 and i % 5]
    mask = (1 << 64) - 1
    k1, k2 = int(quality._K1), int(quality._K2)

    def grams(t):
        h = [zlib.crc32(w.encode()) for w in t.split()]
        return [(x * k1 & mask) >> 48 for x in h] + [(((a * k1 + (b + 1) * k2) & mask) * k1 & mask) >> 48 for a, b in zip(h, h[1:])]

    counts = [Counter(grams(t)) for t in texts]
    raw = Counter()
    for c in counts:
        raw.update(c)
    whole = sum(raw.values()) + 0.5 * quality.BUCKETS
    scores = {}
    for i, c in enumerate(counts):
        own = Counter()
        for j in trusted:
            if fold[j] != fold[i]:
                own.update(counts[j])
        n = own.total()
        lead = lambda b: math.log((own[b] + (raw[b] + 0.5) / whole * max(1.0, 0.25 * n)) / (n + max(1.0, 0.25 * n))) - math.log((raw[b] + 0.5) / whole)  # noqa: B023, E731
        scores[i] = sum(k * lead(b) for b, k in c.items()) / c.total()
        assert got[i].score == pytest.approx(scores[i], abs=1e-9)
    mine = sorted(scores[i] for i in trusted if not got[i].base_failed)
    low, mid = np.quantile(mine, [quality.KEEP, 0.5])
    assert threshold == pytest.approx(low - quality.SLACK * (mid - low), abs=1e-9)
    assert all(got[i].kept == (not got[i].base_failed and got[i].score >= threshold) for i in got)


def test_quality_does_not_depend_on_the_sample(spark, sf):
    """Good documents in the trusted half and in the other half are kept alike."""
    big = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    good = labels.filter("quality = 1 AND toxic = 0")
    ids = quality.trusted_ids(labels.filter("doc_id % 2 = 0"))
    ratio = quality.fit_ratio(docs, ids)
    kept = quality.score_quality(docs, ratio, quality.fit_threshold(docs, ids, ratio)).filter("NOT base_failed").join(good, "doc_id")
    share = {r.odd: r.k for r in kept.groupBy((kept.doc_id % 2).alias("odd")).agg({"kept": "count"}).withColumnRenamed("count(kept)", "n").join(
        kept.filter("kept").groupBy((kept.doc_id % 2).alias("odd")).count(), "odd").selectExpr("odd", "count / n AS k").collect()}
    assert abs(share[0] - share[1]) < 0.03 and min(share.values()) > 0.9, share


# ---- 4: packing ----


@pytest.mark.parametrize("block", [packing.BLOCK_TOKENS, 700])
def test_packing(docs, empty, block):
    got = packing.pack_documents(clashing(docs), block_tokens=block).collect()
    tk = encoder(default_path()).tokenizer
    want = Counter()
    for d, t, *_ in rows():
        want[d, np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()] += 1
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for (d, ids), copies in want.items():
        mine = sorted(pieces[d], key=lambda r: r.start)
        assert sum(r.length for r in mine) == copies * len(ids) // 4
        for r in mine:
            assert r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    pad = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        pad += 0 if at & (at - 1) == 0 else 1024 - at
    assert pad <= 1024 * docs.rdd.getNumPartitions()
    assert packing.pack_documents(empty).collect() == []


def test_windows_are_full():
    r = random.Random(4)
    pieces = [(r.randint(1, 1024), i, 0) for i in range(500)]
    full, rest = packing.fill_windows(pieces)
    assert all(sum(n for n, _, _ in w) == t for t, w in full)
    assert sum(n for _, w in full for n, _, _ in w) + sum(n for n, _, _ in rest) == sum(n for n, _, _ in pieces)
    tiers = [t for t, _ in full]
    load = Counter()
    for t, g in zip(tiers, packing.step_groups(tiers, 1 << 14)):
        load[g] += t
    assert max(load.values()) - min(load.values()) <= 1024


# ---- 5: repeats ----


@pytest.mark.parametrize("shard", [suffix_dedup.SHARD, 2])
def test_repeats(docs, shard):
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(clashing(docs), shard=shard).collect()), key=str)
    bodies = [(d, (t or "").encode()) for d, t, *_ in rows()]
    seen = Counter(b[i : i + 400] for _, b in bodies for i in range(len(b) - 399))
    want = []
    for d, b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("share", [suffix_dedup.HOT_SHARE, 4])
def test_planted_repeats(spark, monkeypatch, share):
    """Repeats of 399, 400 and 401 bytes and more, within and across texts, one anchor in most: all found, no byte more."""
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", share)
    r = random.Random(11)
    raw = lambda n: "".join(r.choices("abcdefghijklmnop ", k=n))
    runs = {n: raw(n) for n in (399, 400, 401, 900)}
    texts = [raw(300) + "#" + runs[n] + "$" + raw(200) + "%" + runs[n] + "&" + raw(50) for n in (399, 400)]
    texts += [raw(100) + f"<{i}" + runs[401] + f"{i}>" + raw(k) for i, k in enumerate((0, 500, 30))]
    texts += [chr(33 + i) + runs[900] + chr(65 + i) + raw(40) for i in range(30)] + [raw(2000) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(df).collect()}
    assert got[0].n_removed == 0 and (got[1].n_removed, got[1].n_spans) == (800, 2)
    assert [got[i].n_removed for i in (2, 3, 4)] == [401] * 3 and [got[i].n_removed for i in range(5, 35)] == [900] * 30
    assert all(got[i].n_removed == 0 and got[i].kept_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i in range(35, 45))


def test_long_texts_are_scanned_in_slices():
    """Every window has one region whatever the slices, and equal windows have equal anchors."""
    import pyarrow as pa

    r = random.Random(12)
    part = bytes(r.choices(b"abcdef", k=1500))
    body = part + bytes(r.choices(b"abcdef", k=3000)) + part
    seen = []
    for buffer in (1 << 20, 1000, 401):
        anchor = np.zeros(len(body), np.int64)
        times = np.zeros(len(body), int)
        for b in suffix_dedup._scan(iter([pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["body"])]), buffer):
            for x in b.to_pylist():
                anchor[x["start"] : x["start"] + x["windows"]] = x["anchor"]
                times[x["start"] : x["start"] + x["windows"]] += 1
        assert (times[: len(body) - 399] == 1).all() and not times[len(body) - 399 :].any()
        seen.append(anchor)
    assert (seen[0] == seen[1]).all() and (seen[0] == seen[2]).all()
    assert (seen[0][:1101] == seen[0][4500:5601]).all()


def test_repeats_empty(empty):
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    for _ in range(40):
        x = r.integers(97, 97 + int(r.integers(1, 4)), int(r.integers(9, 300))).astype(np.uint8)
        b, depth = x.tobytes(), int(r.choice([16, 20, 64, 400]))
        sa, rank = suffix_dedup.suffix_array(x, depth)
        cut = [b[i : i + depth] for i in sa]
        assert cut == sorted(cut) and sorted(sa) == list(range(len(b)))
        lcp = suffix_dedup.kasai(x, sa, rank, np.array([0]), np.array([len(b)]), depth)
        for i, j in zip(sa[1:], sa[:-1]):
            k = 0
            while k < depth and max(i, j) + k < len(b) and b[i + k] == b[j + k]:
                k += 1
            assert lcp[i] == k


# ---- 6: token files ----


def test_range_coder_round_trip():
    r = np.random.default_rng(2)
    cases = [r.integers(0, 65536, (7, 300)), np.zeros((3, 500), int), r.integers(0, 3, (5, 2048)), np.full((2, 64), 65535), r.integers(0, 50000, (1, 1)), r.integers(0, 2**31, (3, 2048)), r.integers(0, 2**32, (5, 700)), np.full((2, 9), 2**32 - 1), np.tile(r.integers(0, 50000, (4, 40)), 20)]
    for ids in cases:
        assert (range_coder.decode_blocks(range_coder.encode_blocks(ids), ids.shape[1]) == ids).all()
    assert sum(map(len, range_coder.encode_blocks(cases[-1]))) < cases[-1].size / 4  # repeats cost less than two bits an id
    with pytest.raises(ValueError):
        range_coder.encode_blocks(np.zeros((1, range_coder.BLOCK_IDS + 1), int))


def test_order_0_predicts_ids():
    """Ids without any order, but of unequal frequency, cost about their entropy and the first appearances."""
    r = np.random.default_rng(5)
    p = 0.5 ** np.arange(1, 12)
    ids = r.choice(40_000 + np.arange(11), (16, 2048), p=p / p.sum())
    entropy = -(p / p.sum() * np.log2(p / p.sum())).sum() / 8
    assert sum(map(len, range_coder.encode_blocks(ids))) / ids.size < 1.5 * entropy


def test_blocks_beat_deflate(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    ids = np.concatenate([np.frombuffer(x, "<u4") for x in encoder(default_path()).encode(texts)])
    ids = ids[: len(ids) // 2048 * 2048].reshape(-1, 2048)
    ours = sum(map(len, range_coder.encode_blocks(ids))) / ids.size
    assert ours < 1.1 and ours < sum(len(zlib.compress(x.astype("<u2").tobytes(), 6)) for x in ids) / ids.size

@pytest.mark.parametrize("lanes", [token_file.LANES, 1])
def test_token_files(spark, docs, empty, lanes):
    folder = new_path(spark, "tids")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_file.read_token_files(token_file.write_token_files(clashing(docs), folder, lanes=lanes), folder).collect())
    tk = encoder(default_path()).tokenizer
    want, at = [], 0
    for d, t, *_ in sorted(rows(), key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((at, d, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_file.read_token_files(token_file.write_token_files(empty, folder), folder).collect() == []


def test_damaged_block_is_noticed():
    frame = bytearray(token_file._frame([(1, 5, True)], np.array([5, 6, 7, 8, 9], "<u4")))
    frame[-6] ^= 1
    with pytest.raises(ValueError):
        list(token_file._frames(__import__("io").BytesIO(bytes(frame))))


# ---- 7: n-gram join ----


def brute_components(data, n, percent):
    sets = []
    for d, t, *_ in data:
        w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in __import__("re").split("[\x20\x09-\x0d]+", t or "") if x]
        sets.append((d, {tuple(w[i : i + min(n, len(w))]) for i in range(max(1, len(w) - n + 1))} if w else set()))
    root = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root[i], root[j]))
                root = [x if k == y else k for k in root]
    ids = defaultdict(list)
    for (d, _), r in zip(sets, root):
        ids[r].append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    return sorted(((d, len(s), least[r]) for (d, s), r in zip(sets, root)), key=str)


@pytest.mark.parametrize("n,percent,block", [(4, 85, 1000), (4, 85, 2), (5, 80, 3)])
def test_similar_components(docs, n, percent, block):
    got = sorted((tuple(r) for r in ngram_join.similar_components(clashing(docs), n, percent, block).collect()), key=str)
    assert got == brute_components(rows(), n, percent)


def test_similar_components_of_a_large_group(spark):
    base = words(50, 200).split()
    r = random.Random(3)
    data = []
    for i in range(60):
        w = list(base)
        for k in r.sample(range(200), r.randint(0, 4)):
            w[k] = f"w{i}x{k}"
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((tuple(x) for x in ngram_join.similar_components(df, 4, 85, 8).collect()), key=str)
    assert got == brute_components(data, 4, 85)


def test_similar_components_of_heavy_sets(docs, monkeypatch):
    """Blocks by bytes: sets heavier than a block allows are dealt out, and no link is lost."""
    monkeypatch.setattr(ngram_join, "UNIT_BYTES", 1500)
    got = sorted((tuple(r) for r in ngram_join.similar_components(docs, 5, 80, 50).collect()), key=str)
    assert got == brute_components(rows(), 5, 80)


def test_similar_components_empty(empty):
    assert ngram_join.similar_components(empty).collect() == []


def test_a_shared_prefix_shingle_ties_nothing(spark, monkeypatch):
    """Documents without links that share one shingle, which no frequent bucket shows, are never copied to pairs."""
    monkeypatch.setattr(ngram_join, "frequent_buckets", lambda docs, n: np.zeros(ngram_join.BUCKETS, bool))
    shared = min((words(7000 + i, 4) for i in range(400)), key=lambda t: int(ngram_join.shingles(t, 4)[0]))
    data = [(i, shared + " " + words(20_000 + i, 12)) for i in range(20_000)] + [(30_000, shared + " " + words(20_007, 12) + " end")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    copied = []
    links = ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda members, percent: copied.append(members.count()) or links(members, percent))
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(df, 4, 85, 50).collect()}
    assert got == {i: i for i in range(20_000)} | {30_000: 7}
    assert sum(copied) < 100


def test_common_shingles_beyond_the_broadcast(spark):
    base = words(60, 120).split()
    r = random.Random(6)
    data = [(i, " ".join(w if r.random() > 0.02 else f"x{i}" for w in base)) for i in range(40)] + [(100 + i, " ".join(base[:40]) + " " + words(500 + i, 70)) for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    real = ngram_join.prefix_tokens
    small = lambda *a: real(*a, most=0)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ngram_join, "prefix_tokens", small)
        got = sorted((tuple(x) for x in ngram_join.similar_components(df, 4, 85, 8).collect()), key=str)
    assert got == brute_components(data, 4, 85)


def test_ties_by_tree_match_the_plain_loop():
    r = np.random.default_rng(3)
    rows = []
    for k in range(200):
        x = np.unique(r.integers(0, 2**63, int(r.integers(20, 300))).astype(np.uint64)) if k % 4 == 0 else x[r.random(len(x)) < 0.97]
        b = ngram_join.bitmap_of(x)
        rows.append((len(x), k, 8 * len(b), int.from_bytes(b, "little")))
    rows.sort()
    few, many = ngram_join._tie_few(rows, 85), ngram_join._tie_many(rows, 85)
    assert len(set(few)) == len(set(many.tolist())) == len(set(zip(few, many.tolist())))


def test_drop_near_duplicates_keeps_one_of_each(spark):
    a, b, r, n = (words(80 + k, 40) for k in range(4))
    rows = [(1, a), (2, a), (1, b), (5, r), (5, r), (None, n), (None, n), (6, ""), (6, ""), (7, None), (8, n + " more")]
    df = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row string, sha long")
    got = ngram_join.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted([(1, a), (1, b), (5, r), (8, n + " more"), (6, ""), (6, ""), (7, None)], key=str)


def test_link_members_matches_brute_force():
    r = np.random.default_rng(0)
    for trial in range(25):
        base = [np.unique(r.integers(0, 2**63, int(r.integers(3, 300))).astype(np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(int(r.integers(2, 90))):
            b = base[r.integers(0, 4)]
            s = np.unique(np.concatenate([b[r.random(len(b)) < r.choice([1, 0.95, 0.9])], r.integers(0, 2**63, int(r.integers(0, 5))).astype(np.uint64)]))
            sets.append(s if len(s) else base[0])
        side = r.integers(0, 2, len(sets)) if trial % 2 else np.ones(len(sets), int)
        want = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if (side[i] or side[j]) and 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                    a, b = sorted((want[i], want[j]))
                    want[want == b] = a
        assert (ngram_join.link_members(sets, np.arange(len(sets)), side, 85) == want).all()


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 40)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(7, 7)]
    got = {x.node: x.component for x in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}
    for a, b in edges:
        x, y = sorted((root[a], root[b]))
        root = {k: x if v == y else v for k, v in root.items()}
    assert got == {k: v for k, v in root.items() if k != v}


# ---- 8: language ID ----


def test_language_id_held_out(spark):
    lang = {"en": "the and of that with from have this are was", "fr": "le la les des que dans pour est une sur", "de": "der die das und nicht mit ein ist auf von"}
    r = random.Random(5)
    data = [(i, " ".join(r.choices(lang[k].split(), k=30)), k) for i in range(300) for k in [list(lang)[i % 3]]]
    data += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, "the and of", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(language_id.training_rows(df))
    got = {x.doc_id: x for x in language_id.predict_language(clashing(df), model).collect()}
    held = [i for i, _, k in data if i < 1000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 40 and np.mean([got[i].lang_pred == data[i][2] for i in held]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].lang_score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred == "en"
    assert all(0 <= x.lang_score <= 1 for x in got.values())
    assert {x.doc_id for x in language_id.keep_identified(df).collect()}.isdisjoint({1000, 1001, 1002})


def test_features_are_code_points():
    """Bigrams and trigrams of characters: one of three bytes counts once."""
    assert len(language_id.feature_ids("東京都")) == 4 + 3 and len(language_id.feature_ids("ab")) == 3 + 2
    assert set(language_id.feature_ids("東京")) & set(language_id.feature_ids("x東京y")) and (language_id.feature_ids("ÀB") == language_id.feature_ids("àb")).all()
    assert len(language_id.feature_ids("\ud800")) == 3


def test_ftrl_by_brute_force(monkeypatch):
    monkeypatch.setattr(language_id, "DIMS", 12)
    r = np.random.default_rng(4)
    rows = [(np.sort(r.choice(12, 4, replace=False)), r.random(4), int(r.integers(0, 3))) for _ in range(30)]
    weights, bias = language_id.fit_ftrl(rows, 3, epochs=2)
    a, b, l1, l2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2
    z, n, c, m = [[0.0] * 12 for _ in range(3)], [[0.0] * 12 for _ in range(3)], [0.0] * 3, [0.0] * 3

    def w(k, i):
        return 0.0 if abs(z[k][i]) <= l1 else -(z[k][i] - math.copysign(l1, z[k][i])) / ((b + math.sqrt(n[k][i])) / a + l2)

    order = np.random.default_rng(8)
    for _ in range(2):
        for t in order.permutation(len(rows)):
            at, x, y = rows[t]
            now = [[w(k, i) for i in at] for k in range(3)]
            logit = [sum(u * v for u, v in zip(now[k], x)) + c[k] for k in range(3)]
            e = [math.exp(v - max(logit)) for v in logit]
            for k in range(3):
                err = e[k] / sum(e) - (k == y)
                for u, i, v in zip(now[k], at, x):
                    g = err * v
                    z[k][i] += g - (math.sqrt(n[k][i] + g * g) - math.sqrt(n[k][i])) / a * u
                    n[k][i] += g * g
                m[k] += err * err
                c[k] -= 0.1 * err / math.sqrt(1 + m[k])
    assert np.allclose(weights, [[w(k, i) for i in range(12)] for k in range(3)]) and np.allclose(bias, c)
    monkeypatch.setattr(language_id, "L1", 1.0)
    assert (language_id.fit_ftrl(rows, 3, epochs=2)[0] == 0).any()


def test_language_id_edges(spark):
    """Repeated rows, ties, a very long text, clashing columns with a fitted model, languages past the bound of the sample."""
    data = [(i, ("the and of " if i % 2 else "der die das ") * 5, "en" if i % 2 else "de") for i in range(80)]
    data += [(90, "the and of " * 60_000, "en"), (3, data[3][1], "en"), (None, "the and of", "en"), (91, "zz", None)]
    df = clashing(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    got = language_id.predict_language(df, language_id.fit_language_model(language_id.training_rows(df), per_lang=10)).collect()
    assert len(got) == len(data) and len({(r.lang_pred, r.lang_score) for r in got if r.doc_id == 3}) == 1
    assert {r.lang_pred for r in got if r.doc_id in (90, None)} == {"en"} and all(0 <= r.lang_score <= 1 for r in got)
    left = language_id.keep_identified(df)
    assert left.columns == df.columns and {(r.lang_pred, r.lang_score) for r in left.collect()} == {("x", "x")}


def test_language_id_of_ids_with_two_texts(spark):
    """One id with texts in two languages: both are learned from, and the model is the same however rows are dealt."""
    data = [(i, "the and of " * 4 + str(i), "en") for i in range(30)] + [(i, "der die das " * 4 + str(i), "de") for i in range(30)]
    models = [language_id.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n), per_lang=20) for rows, n in ((data, 3), (data[::-1], 5))]
    assert models[0].langs == ["de", "en"] and np.allclose(models[0].weights, models[1].weights) and np.abs(models[0].weights).sum() > 0


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGS", 3)
    df = spark.createDataFrame([(i, "text", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.fit_language_model(df)


def test_language_id_without_labels(docs, empty):
    assert {r.lang_pred for r in language_id.predict_language(docs, None).collect()} == {"und"}
    assert language_id.fit_language_model(language_id.training_rows(empty)) is None
    assert language_id.predict_language(empty, None).collect() == []


def test_temperature_calibrates():
    r = np.random.default_rng(0)
    z = r.normal(size=(400, 3))
    y = np.array([r.choice(3, p=language_id.softmax(row)) for row in z])
    assert language_id.fit_temperature(5 * z, y) == pytest.approx(5, rel=0.25)
    assert math.isclose(language_id.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)), 1.0)


# ---- tokens ----


def test_encoder_equals_tokenizer():
    e = encoder(default_path())
    texts = [t or "" for _, t, *_ in rows()] + ["  a\n\n b  ", "it's  we'll 12½ ²x_y", "a\x1cb\x85c\xa0 d", "É tion  ", " \t\nfoo", " 'tis don'T", "x y", "€5—ok…"]
    for t, got in zip(texts, e.encode(texts)):
        assert np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == got
