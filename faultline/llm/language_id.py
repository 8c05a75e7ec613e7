"""Language identification (operator 8): sparse multinomial logistic regression on TF-IDF character n-grams.

Bigrams and trigrams of code points of the lower-cased text are hashed into ``DIMS`` features. Document frequencies
come from every training document. The weights are fitted by follow-the-regularised-leader with elastic-net penalties
on a bounded sample (at most ``per_lang`` documents of each language, fewer of each if there are many languages, and
``MOST_SAMPLED`` in all), which reaches the driver as counts of hashed features, at most ``DIMS`` a document. Every
language is learned; more than ``MOST_LANGS`` of them are an error, as weights are held densely. A temperature,
fitted on every fifth document of that sample, calibrates the probabilities. Prediction is a narrow
pass over all documents with the weights broadcast: ``DIMS`` x languages numbers, whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

BITS = 15
DIMS = 1 << BITS
#: Languages that a model may tell apart, at most.
MOST_LANGS = 500
#: Bounds of the training sample: for each language, and in all.
PER_LANG, MOST_SAMPLED = 700, 100_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UND = "und"
#: Calibrated probability under which a filter rejects a document.
MIN_SCORE = 0.4


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


_PRIME, _THIRD, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - BITS)


def feature_ids(text: str) -> np.ndarray:
    """Hashed bigrams and trigrams of code points of the lower-cased text between spaces."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    two = c[:-1] << np.uint64(21) | c[1:]
    three = two[:-1] << np.uint64(21) | c[2:]
    mixed = np.concatenate([two * _PRIME, (three ^ three >> np.uint64(31)) * _THIRD])
    return (mixed >> _SPREAD).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids in ascending order and how often each occurs."""
    n = np.bincount(feature_ids(text), minlength=DIMS)
    at = np.flatnonzero(n)
    return at, n[at]


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """L2-normalised weights (1 + ln tf) * idf."""
    x = (1.0 + np.log(n)) * idf[at]
    return x / np.sqrt(x @ x)


def tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counted(text)
    return at, weighted(at, n, idf)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes x DIMS) and bias by FTRL-proximal with L1 and L2 penalties; the bias is not penalised."""
    z, n = np.zeros((classes, DIMS)), np.zeros((classes, DIMS))
    bias, bias_n = np.zeros(classes), np.zeros(classes)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(8)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            zi, ni = z[:, at], n[:, at]
            w = weights(zi, ni)
            error = softmax(w @ x + bias)
            error[y] -= 1.0
            g = error[:, None] * x
            n_new = ni + g * g
            z[:, at] = zi + g - (np.sqrt(n_new) - np.sqrt(ni)) / ALPHA * w
            n[:, at] = n_new
            bias_n += error * error
            bias -= 0.1 * error / np.sqrt(1.0 + bias_n)
    return weights(z, n), bias


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log-loss, by golden-section search over its logarithm; 1 without rows."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -float(np.mean(np.log(p[np.arange(len(truth)), truth] + 1e-12)))

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, seen = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for text in batch["text"]:
            df[np.unique(feature_ids(text.as_py()))] += 1
            seen += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], seen))], ["feature", "df"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed feature ids and counts of each document; empty if it has no letter."""
    for batch in batches:
        ids, counts = [], []
        for text in batch["text"].to_pylist():
            at, n = counted(text) if has_letter(text) else (np.zeros(0), np.zeros(0))
            ids.append(at.astype(np.uint16).tobytes())
            counts.append(n.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["lang"], pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "lang", "at", "n"])


def fit_language_model(train: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """``train``: doc_id, text, lang without nulls. None if there is nothing to learn from, as in an empty table.

    One id with two texts is two documents; rows that repeat id, text and language are one. Long texts count as a whole.
    """
    known = train.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(known) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    per_lang = min(per_lang, max(1, MOST_SAMPLED // max(1, len(known))))
    top = train.sparkSession.createDataFrame([(r.lang, r["count"]) for r in known], "lang string, count long")
    train = train.withColumn("said", F.xxhash64("text"))
    # a sample by hashed id of about twice the bound, then exactly the bound
    rate = F.lit(2.0 * per_lang) / F.col("count")
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ids = train.select("doc_id", "said", "lang").join(F.broadcast(top), "lang").filter(unit < rate).select("doc_id", "said", "lang", unit.alias("u")).distinct()
    ids = ids.selectExpr("doc_id", "said", "lang", "row_number() OVER (PARTITION BY lang ORDER BY u, doc_id, said) AS rank").filter(F.col("rank") <= per_lang).drop("rank")
    sample = train.join(F.broadcast(ids), ["doc_id", "said", "lang"]).dropDuplicates(["doc_id", "said", "lang"])
    # MOST_SAMPLED documents at most, of at most DIMS features each, whatever the length of the texts
    order = [F.xxhash64("doc_id"), "doc_id", "said", "lang"]
    rows = sample.orderBy(*order).select("doc_id", "text", "lang").mapInArrow(_features, "doc_id long, lang string, at binary, n binary").collect()
    langs = sorted({r.lang for r in rows})
    if not langs:
        return None
    counts = train.select("text").mapInArrow(_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()  # at most DIMS + 1 rows
    df, seen = np.zeros(DIMS), 0
    for f, n in counts:
        if f < 0:
            seen = n
        else:
            df[f] = n
    idf = np.log((1.0 + seen) / (1.0 + df)) + 1.0
    data = []
    for r in rows:
        if len(r.at):
            at = np.frombuffer(r.at, np.uint16).astype(np.int64)
            data.append((at, weighted(at, np.frombuffer(r.n, np.uint32), idf), langs.index(r.lang)))
    fit, held = [x for i, x in enumerate(data) if i % 5], [x for i, x in enumerate(data) if not i % 5]
    weights, bias = fit_ftrl(fit, len(langs))
    logits = np.array([weights[:, at] @ x + bias for at, x, _ in held]).reshape(len(held), len(langs))
    return Model(langs, idf, weights, bias, fit_temperature(logits, np.array([y for *_, y in held], int)))


def predict_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and lang_score appended; clashing columns of ``docs`` are replaced.

    ``und`` with score 0 for null texts, texts without a letter, and if there is no model. Rows are judged one by one, so
    repeated rows and ids make no difference; long texts count as a whole; of equal probabilities the first language wins.
    """
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        w = None if m is None else np.ascontiguousarray(m.weights.T)
        for batch in batches:
            langs, scores = [], []
            for text in batch["text"]:
                text = text.as_py()
                if m is None or not has_letter(text):
                    langs.append(UND)
                    scores.append(0.0)
                    continue
                at, x = tfidf(text, m.idf)
                p = softmax((x @ w[at] + m.bias) / m.temperature)
                best = int(p.argmax())
                langs.append(m.langs[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(training_rows(docs))
    out = predict_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows whose language is undetermined or has a calibrated probability under min_score.

    All columns come back as they were, also those named lang_pred or lang_score. Null texts and texts without a
    letter go, and so does everything if no row has a language to learn from. Repeated rows share one verdict.
    """
    # the row travels as one column, so that the model's names can't clash with it
    rows = docs.select(F.struct("*").alias("row"), "text")
    out = predict_language(rows, fit_language_model(training_rows(docs)))
    return out.filter((F.col("lang_pred") != UND) & (F.col("lang_score") >= min_score)).select("row.*")
