"""Corpus preparation in stages: each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm.exact_dedup import drop_exact_duplicates
from faultline.llm.language_id import keep_identified
from faultline.llm.mixing import keep_sampled
from faultline.llm.ngram_join import drop_near_duplicates
from faultline.llm.packing import pack_documents
from faultline.llm.shared import save, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined or hardly likely go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return drop_exact_duplicates(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the Jaccard similarity of five-word shingles, 0.8 or more, the least doc_id stays."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards the target weights of sources, languages and topics."""
    return keep_sampled(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return pack_documents(docs)


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("n-gram Jaccard join", ngram_join), ("mix sources", mix_sources), ("packing", packing)]
#: The n-gram join and packing can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
