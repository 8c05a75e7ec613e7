"""Line runs, the conversation trie and lexical search against brute-force versions on small tables with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from faultline.llm import conversation_trie, lexical_search, line_dedup

from .test_operators import DOCS, clashing, words

BLANK = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MORE = ("line_doc", "line_text", "gone", "body", "lines", "h1", "h2", "doc", "batch", "hi", "words", "part", "turns", "lead", "head", "h", "item_id", "rank", "terms", "path", "m")


def crowded(df):
    """Extra columns under names that the operators use inside."""
    for name in MORE:
        if name not in df.columns:
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


# ---- 11: lines ----


def line_rows():
    a, b, c = "Shared  line of twenty code points", "ÉTÉ line that a few documents hold", "exactly twenty chars"
    out = [(i, f"{a}\nown {words(i, 6)}\n{b if i < 3 else 'x'}\n", "en", "s", 1) for i in range(1, 9)]
    out += [(9, f"\t{a.upper()} \r\n{a}\n{a}", "en", "s", 1), (10, None, None, None, None), (11, "", "en", "s", 0), (12, "\n\n", "en", "s", 0), (13, c, "en", "s", 0), (14, c + "\x0b", "en", "s", 0), (15, f"  {c}", "en", "s", 0)]
    out += [(16, c[:-1], "en", "s", 0), (17, c[:-1], "en", "s", 0), (18, c[:-1], "en", "s", 0), (20, "same id, first of its texts", "en", "s", 0), (20, "same id, first of its texts\nmore", "en", "s", 0), (21, "same id, first of its texts", "en", "s", 0)]
    out += [(None, f"no id at all but this line\n{a}", "en", "s", 0), (None, f"no id at all but this line\n{b}", "en", "s", 0), (30, "twice the same row of the table", "en", "s", 0), (30, "twice the same row of the table", "en", "s", 0)]
    out += [(40, "\n".join(f"long text, line number {k % 700} of it" for k in range(5000)), "en", "s", 0), (41, "\n".join(f"long text, line number {k} of it" for k in range(300)), "en", "s", 0), (42, "long text, line number 7 of it", "en", "s", 0)]
    return out


def brute_lines(rows):
    key = lambda x: x.strip(BLANK).translate(UPPER)
    held = defaultdict(set)
    low = -(1 << 63)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(low if d is None else d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < 3 or (low if d is None else d) == max(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches,fanout", [(4, 2), (1, 2), (7, 3)])
def test_lines(spark, batches, fanout):
    df = crowded(clashing(spark.createDataFrame(line_rows(), DOCS))).repartition(3)
    got = line_dedup.drop_repeated_lines(df, batches=batches, fanout=fanout).select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert Counter(map(tuple, got)) == Counter(brute_lines(line_rows()))


def test_lines_of_no_documents(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], DOCS)).collect() == []
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([(None, None, None, None, None)], DOCS)).select("n_lines", "n_dropped", "kept_text").collect() == [(1, 0, "")]


def test_runs_are_compacted_and_settled(spark):
    """Four batches at a fanout of two leave one run of level 2; a line that a run has settled isn't stored again."""
    runs = line_dedup.LineRuns(spark, least=3, fanout=2)
    batch = lambda rows: spark.createDataFrame(rows, "h1 long, h2 long, doc long")
    runs.add(batch([(1, 1, 90), (1, 1, 91), (1, 1, 92), (1, 1, 92), (2, 2, 90)]))
    runs.add(batch([(1, 1, 50), (2, 2, 51), (3, 3, 52)]))
    assert [len(x) for x in runs.levels] == [0, 1]
    runs.add(batch([(1, 1, 99), (2, 2, 40), (1, 1, 41)]))
    name = runs.levels[0][0][0]
    assert {(r.h1, r.docs, r.hi) for r in spark.table(name).collect()} == {(1, 2, 99), (2, 1, 40)}
    runs.add(batch([(1, 1, 3), (3, 3, 4)]))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert {tuple(r) for r in runs.repeated().collect()} == {(1, 1, 99), (2, 2, 90)}
    runs.close()


# ---- 12: trie ----


def brute_rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + mine[h:]
    return out


def brute_trie(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * n
    end = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(nodes[k]) if len(convs[c]) == len(k)).encode()).hexdigest()
    return Counter((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], end(k)) for k, m in nodes.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_rows():
    r, out = random.Random(5), []
    for c in range(160):  # few texts, so that prefixes are shared; a third are copies of one conversation
        if c % 3 == 0:
            out += [(c, t, "user", f"hot turn {t} of it") for t in range(6)]
        else:
            out += [(c, t, r.choice(["user", "assistant"]), f"text {r.randrange(2)} \t of  turn") for t in range(r.randrange(1, 8))]
    out += [(200, 0, None, None), (201, None, "user", "before all"), (201, 0, "user", None), (201, 0, "user", None), (202, 5, "user", ""), (-7, 1, "user", "below zero"), (-7, 0, "user", "first"), (None, 0, "user", "no conversation")]
    out += [(300, t, "user", f"long {t}") for t in range(700)] + [(301, t, "user", f"long {t}") for t in range(650)] + [(302, t, "user", f"long {min(t, 400)}") for t in range(500)]
    out += [(403, 0, "user", "taken away"), (404, 1, "ab", "c"), (405, 1, "a", "bc"), (3000, 0, "user", "dup"), (3000, 0, "user", "dup")]
    return out


@pytest.mark.parametrize("size", [1 << 24, 2000, 300])
def test_trie(spark, size):
    rows = conversation_rows()
    df = crowded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(3)
    convs = brute_rebuild(rows)
    rebuilt = conversation_trie.with_shared_heads(conversation_trie.turn_sequences(df))
    got = conversation_trie.prefix_trie(rebuilt, size).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == brute_trie(convs)


def test_trie_of_conversations_without_turns(spark):
    """Conversation 1 loses its only turn, as it shares the first of a conversation that isn't there."""
    schema = "conv_id long, turn long, role string, text string"
    c = next(i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 4)
    for rows in ([], [(c, 0, "user", "gone")]):
        got = conversation_trie.prefix_trie(conversation_trie.with_shared_heads(conversation_trie.turn_sequences(spark.createDataFrame(rows, schema)))).select(*COLUMNS).collect()
        assert Counter(map(tuple, got)) == brute_trie(brute_rebuild(rows))
        assert len(got) == len(rows)


def test_chains_join_at_equal_depths():
    """Three branches of one node at depth 1, one of them two deep; the first item ends at the node."""
    got = conversation_trie.chains([1, 1, 0], [1, 2, 3, 2], [1, 1, 1, 1], [4, 3, 2, 1])
    assert {tuple(c[:7]) for c in got} == {(1, 1, 1, 2, 0, 1, 3), (2, 2, 1, 3, 0, 1, 2), (0, 2, 0, 1, 2, 3, 2), (3, 3, 0, 2, 0, 1, 1), (0, 3, -1, 0, 1, 4, 1)}
    assert all(got[c[7]][3] == c[2] for c in got if c[7] >= 0)


# ---- 13: search ----


def brute_search(docs, items, k=10):
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER)) if x]
    bags = [(d, Counter(split(t))) for d, t, *_ in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(split(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if b[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def search_rows():
    r = random.Random(3)
    pool = [words(1000 + i, 1) for i in range(150)] + ["été", "東京", "x" * 40]
    text = lambda n: " ".join(r.choice(pool[: r.choice([10, 60, 153])]) + r.choice([" ", ".", "\n", "_", "X_"]) for _ in range(n))
    docs = [(i, text(r.choice([1, 5, 30, 200])), "en", "s", 1) for i in range(400)]
    docs += [(400 + i, docs[7][1], "en", "s", 1) for i in range(90)]  # copies: ties go by id
    docs += [(None, docs[3][1], "en", "s", 1), (3, docs[3][1], "en", "s", 1), (900, None, None, None, None), (901, "", "en", "s", 0), (902, "... --", "en", "s", 0), (903, text(20_000) + "y" * 3_000_000 + " " + text(5), "en", "s", 0)]
    items = [(i, text(25)) for i in range(12)] + [(12, docs[7][1]), (13, None), (14, "nowhere-to-be-found"), (15, text(3)), (15, text(4)), (None, text(6)), (None, text(2))]
    return docs, items


@pytest.mark.parametrize("most", [lexical_search.MOST_ITEMS, 3])
def test_search(spark, most):
    docs, items = search_rows()
    d = crowded(clashing(spark.createDataFrame(docs, DOCS))).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.top_documents(d, q, most=most).select("item_id", "rank", "doc_id", "score").collect()
    assert Counter(map(tuple, got)) == brute_search(docs, items)


def test_search_of_nothing(spark):
    none, q = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.top_documents(none, q).collect() == []
    assert lexical_search.top_documents(spark.createDataFrame([(1, "a b", "en", "s", 1)], DOCS), q.filter("false")).collect() == []


def test_tree_bounds_hold_and_prune():
    """No node's bound is below a score beneath it, and what the search finds is the exact ranking."""
    r = np.random.default_rng(0)
    vectors = sorted(((np.sort(r.choice(200, r.integers(1, 30), replace=False)), int(r.integers(10, 900))) for _ in range(900)), key=lambda v: v[0].astype(">u4").tobytes())
    m = np.array([x for _, x in vectors])
    tfs = [r.integers(1, 9, len(v)) for v, _ in vectors]
    tree = lexical_search.Tree([v.astype(">u4").tobytes() for v, _ in vectors], [t.astype(np.int64).tobytes() for t in tfs], m)
    ranks, weights = np.array([0, 3, 5, 80, 199]), np.array([900, 800, 700, 4000, 5000])
    exact = np.array([sum(int(w) * (10**9 * int(t[list(v).index(x)]) // (1000 * int(t[list(v).index(x)]) + 8 * mm)) for x, w in zip(ranks, weights) if x in v) for (v, mm), t in zip(vectors, tfs)])
    cols = np.searchsorted(tree.columns, ranks)
    bound = lexical_search.gain(tree.most[:, cols].astype(np.int64), tree.least[:, None]) @ weights
    assert all(bound[k] >= exact[lo:hi].max() for k, (lo, hi) in enumerate(tree.spans))
    got = tree.search(ranks, weights, list(range(900)), [], 10)
    assert [(-s, i) for s, _, i in got] == [(int(exact[i]), int(i)) for i in np.lexsort((np.arange(900), -exact))[:10] if exact[i] > 0]


def test_terms_of_long_texts():
    body = b"A" * (3 << 20) + b" bc," + "Éa".encode() * (1 << 20) + b" d"
    assert [t for part in lexical_search.terms(body) for t in part] == [b"a" * (3 << 20), b"bc", "Éa".encode() * (1 << 20), b"d"]
