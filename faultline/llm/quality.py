"""Quality rules and a hashed n-gram log-likelihood ratio (operator 3).

Two multinomials over hashed word unigrams and bigrams: one from trusted documents, one from the whole corpus.
A document's score is its log-likelihood ratio divided by its number of n-grams; documents under a fixed
threshold, or that fail the base rules, are not kept.

The raw counts cover every document, and the trusted model and the threshold every document labelled good: their
ids are broadcast, so that no text moves, up to ``MOST_BROADCAST``; beyond, they are joined through a shuffle. The count table has ``BUCKETS`` rows whatever the corpus size, which bounds what comes
to the driver and goes back to the tasks; the threshold's quantiles are found exactly, by counts in narrowing ranges.

The models are cross-fitted: ids are dealt to ``FOLDS`` folds by hash, and a document, trusted or not, is scored by
the model that leaves out the trusted documents of its own fold. So no verdict depends on whether the document is
trusted itself, and the threshold is taken from scores of documents that their model has not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import save, table

BUCKETS = 1 << 16
#: Trusted ids that are broadcast at most: some 200 MB.
MOST_BROADCAST = 4_000_000
#: Scores that come to the driver at once, and ranges that they are counted in.
AT_ONCE = 4096
FOLDS = 4
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: The threshold lies under the KEEP quantile of the trusted documents' scores, by SLACK times that quantile's
#: distance from their median.
KEEP, SLACK = 0.002, 0.5
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(48)


def ngram_buckets(words: list[bytes]) -> np.ndarray:
    """Bucket of each unigram, then of each bigram, in text order."""
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    pairs = h[:-1] * _K1 + (h[1:] + np.uint64(1)) * _K2
    return np.concatenate([(h * _K1) >> _K3, (pairs * _K1) >> _K3]).astype(np.int64)


def base_counts(body: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8 and its words."""
    in_words = sum(map(len, words))
    chars = len(body.decode("utf-8", "surrogatepass")) - (len(body) - in_words)
    symbols = len(body) - len(body.translate(None, SYMBOLS))
    lines = [x for x in body.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        hit = np.fromiter((seen[x] > 1 for x in windows), bool, len(windows))
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(hit)] |= hit
        repeated = int(covered.sum())
    return chars, symbols, len(lines) - len(set(lines)), repeated


def fold_of(doc_id: F.Column, folds: int) -> F.Column:
    """The fold of an id; 0 for null."""
    return F.coalesce(F.pmod(F.xxhash64(doc_id.cast("long"), F.lit(3)), F.lit(folds)), F.lit(0)).cast("int")


def _count(folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros((folds, BUCKETS), np.int64)
        for batch in batches:
            for text, fold in zip(batch["text"], batch["fold"].to_pylist()):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if words:
                    n = np.bincount(ngram_buckets(words), minlength=BUCKETS)
                    raw += n
                    if fold is not None:
                        trusted[fold] += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), *(pa.array(t[at]) for t in trusted)], ["bucket", "raw", *(f"t{k}" for k in range(folds))])

    return run


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Every id labelled good and not toxic."""
    return save(labels.filter("quality = 1 AND toxic = 0").select("doc_id").distinct(), "trusted")


def _small(good: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    return F.broadcast(good) if good.count() <= most else good


def log_ratio(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """log P(bucket | trusted) - log P(bucket | corpus) from smoothed raw and plain trusted counts; zeros if nothing is trusted."""
    if not trusted.sum():
        return np.zeros(len(raw))
    # the trusted prior follows the corpus, so that what the trusted documents are too few to show stays neutral
    p = raw / raw.sum()
    t = trusted + p * max(1.0, 0.25 * trusted.sum())
    return np.log(t / t.sum()) - np.log(p)


def fit_ratio(docs: DataFrame, good: DataFrame, smooth: float = 0.5, folds: int = FOLDS) -> np.ndarray:
    """Log-likelihood ratio of each bucket, one row for each fold: the model without that fold's trusted documents."""
    marked = docs.select("doc_id", "text").join(_small(good).withColumn("trusted", F.lit(True)), "doc_id", "left")
    names = [f"t{k}" for k in range(folds)]
    counts = (
        marked.select("text", F.when(F.col("trusted"), fold_of(F.col("doc_id"), folds)).alias("fold"))
        .mapInArrow(_count(folds), "bucket long, raw long, " + ", ".join(f"{n} long" for n in names))
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), *(F.sum(n).alias(n) for n in names))
        .collect()  # at most BUCKETS rows
    )
    raw, trusted = np.full(BUCKETS, smooth), np.zeros((folds, BUCKETS))
    for b, r, *t in counts:
        raw[b] += r
        trusted[:, b] = t
    whole = trusted.sum(axis=0)
    return np.stack([log_ratio(raw, whole - (t if folds > 1 else 0)) for t in trusted])


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def order_statistics(rows: DataFrame, column: str, ranks: list[int], at_once: int = AT_ONCE) -> dict[int, float]:
    """The values at ``ranks`` (from 0) of a column without nulls, exactly.

    Rows are counted in ``at_once`` ranges between the least and the largest value; ranges that hold a rank are looked at
    again by themselves, until they hold one value or few enough to be sorted on the driver.
    """
    c = F.col(column)
    n, lo, hi = rows.agg(F.count(c), F.min(c), F.max(c)).first()
    if lo == hi:
        return dict.fromkeys(ranks, lo)
    if n <= at_once:
        values = sorted(r[0] for r in rows.select(c).collect())
        return {k: values[k] for k in ranks}
    part = F.least(F.floor((c - lo) / (hi - lo) * at_once), F.lit(at_once - 1))
    out, before = {}, 0
    for _, m, first, last in sorted(rows.groupBy(part.alias("part")).agg(F.count(c), F.min(c), F.max(c)).collect()):
        inside = [k - before for k in ranks if before <= k < before + m]
        if inside:
            found = order_statistics(rows.filter(c.between(first, last)), column, inside, at_once)
            out |= {k + before: v for k, v in found.items()}
        before += m
    return out


def fit_threshold(docs: DataFrame, good: DataFrame, ratio: np.ndarray, keep: float = KEEP, slack: float = SLACK) -> float:
    """The score from which documents are kept; 0 if no trusted document passes the base rules."""
    trusted = docs.join(_small(good), "doc_id", "left_semi")
    scores = save(score_quality(trusted, ratio, 0.0).filter("NOT base_failed").select("score"), "scores")
    n = scores.count()
    if not n:
        return 0.0
    at = [q * (n - 1) for q in (keep, 0.5)]
    found = order_statistics(scores, "score", sorted({min(int(x) + k, n - 1) for x in at for k in (0, 1)}))
    low, mid = (found[int(x)] + (x - int(x)) * (found[min(int(x) + 1, n - 1)] - found[int(x)]) for x in at)
    return float(low - slack * (mid - low))


def score_quality(docs: DataFrame, ratio: np.ndarray, threshold: float) -> DataFrame:
    """One row per row of ``docs`` with the base counts, base_failed, score and kept.

    ``ratio``: folds x buckets; the id's fold picks the row. Null and empty texts have no words: they fail the base
    rules and score 0. Repeated rows get equal results. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ratio = np.atleast_2d(np.asarray(ratio, np.float64))
    shared = spark.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows = []
            for text, fold in zip(batch["text"], batch["fold"].to_pylist()):
                body = (text.as_py() or "").encode("utf-8", "surrogatepass")
                words = body.split()
                chars, symbols, dup, repeated = base_counts(body, words)
                failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
                score = float(np.mean(table[fold][ngram_buckets(words)])) if words else 0.0
                rows.append((len(words), chars, symbols, dup, repeated, failed, not failed and score >= threshold, score))
            cols = list(zip(*rows)) if rows else [()] * 8
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types))], [x.split()[0] for x in OUT.split(", ")])

    fold = fold_of(F.col("doc_id"), len(ratio)).alias("fold")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold).mapInArrow(run, OUT)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    good = trusted_ids(table(spark, sf_dir, "labels"))
    ratio = fit_ratio(docs, good)
    return score_quality(docs, ratio, fit_threshold(docs, good, ratio))
