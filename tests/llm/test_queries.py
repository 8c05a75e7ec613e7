"""Registered corpus queries: SQL on the smallest tables, and the pipeline against a brute-force version."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from faultline.llm import mixing
from faultline.llm.queries import QUERIES, SQL
from faultline.llm.tokens import default_path, encoder

from .test_operators import DOCS, brute_components, clashing, rows, words

TABLES = ("documents", "pages", "labels", "benchmark", "conversations")


def test_one_query_for_each_operator():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    as_rows = lambda df: sorted(tuple("" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))
    number = lambda rows: [tuple(x.removesuffix(".000000") for x in r) for r in rows]
    assert number(as_rows(got)) == number(as_rows(want))


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage on its own input, against plain Python, the tokenizer or DuckDB."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf).cache()
        old, new = {r.doc_id: r for r in before.collect()}, docs.collect()
        left = {r.doc_id for r in new}
        if k < 4:
            assert docs.columns == columns and left <= set(old) and all(tuple(r) == tuple(old[r.doc_id]) for r in new)
        if name == "language ID":
            # prose of ten words and more in a language of the table stays; what has no letter goes
            assert {d for d, r in old.items() if r.lang and len((r.text or "").split()) >= 10 and sum(map(str.isalpha, r.text)) > len(r.text) / 2} <= left
            assert not any(d in left for d, r in old.items() if not any(map(str.isalpha, r.text or "")))
        elif name == "exact dedup":
            best = {}
            for r in old.values():
                best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
            assert left == set(best.values())
        elif name == "n-gram Jaccard join":
            assert left == {d for d, _, c in brute_components([(r.doc_id, r.text) for r in old.values()], 5, 80) if c == d}
        elif name == "mix sources":
            before.write.parquet(f"{tmp_path}/before")
            sql = mixing.mix_sql(f"read_parquet('{tmp_path}/before/*.parquet')") + "SELECT doc_id, copies FROM mixed WHERE sampled"
            assert Counter(r.doc_id for r in new) == dict(duckdb.sql(sql).fetchall())
        else:
            tk = encoder(default_path()).tokenizer
            want = Counter()
            for r in before.collect():
                want[r.doc_id] += len(tk.encode(r.text or "", add_special_tokens=False).ids) + 1
            got = Counter()
            for r in new:
                got[r.doc_id] += r.length
            assert got == want
    total = lambda df: {(r[0], r[1]) for r in df.groupBy("doc_id").agg({"length": "sum"}).collect()}  # noqa: E731  where pieces are cut depends on the partitions
    assert total(corpus_pipeline.run(spark, sf)) == total(docs)


def test_pipeline_edges(spark):
    """Nulls, empty and long texts, repeated rows, ids with two texts, clashing columns, an empty table: no stage crashes."""
    extra = rows() + [(4, "another text of the same id " + words(70, 30), "fr", "src2", 3), (None, "no id here", "en", "src1", 3)]
    for docs in (clashing(spark.createDataFrame(extra, DOCS)), spark.createDataFrame([], DOCS)):
        columns, texts = docs.columns, {r.text for r in docs.select("text").collect()}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "").cache()
            if name == "packing":
                assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
                break
            assert out.columns == columns
            if name == "exact dedup":
                kept = [r.text or "" for r in out.collect()]
                assert sorted(kept) == sorted({r.text or "" for r in docs.collect()})
            assert {r.text for r in out.collect()} <= texts
            docs = out
