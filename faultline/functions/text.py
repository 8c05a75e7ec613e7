"""Text columns: cleaning, keys, redaction, signals, chunks. All are built-in column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def text_key(c: Column) -> Column:
    """Lower case, runs of non-word characters to one blank: the key under which texts count as equal."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\W+", " "))


def any_match(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in patterns))


def terms_pattern(terms) -> str:
    return r"(?i)\b(?:" + "|".join(re.escape(t).replace(r"\ ", " ") for t in terms) + r")\b"


def has_term(c: Column, terms) -> Column:
    """Whether a whole phrase of ``terms`` occurs, in any case."""
    return F.coalesce(c.rlike(terms_pattern(terms)), F.lit(False))


def first_sentences(said: Column) -> Column:
    """The first of the sentences with each text key, in their order; those without a word go.

    Sorted by key and place, a sentence stays if the one before it has another key: no sentence is compared with all.
    """
    placed = F.transform(said, lambda s, i: F.struct(text_key(s).alias("k"), i.alias("i"), F.trim(s).alias("t")))
    # one-element arrays bind what is made once and used for every element
    ordered = F.transform(F.array(placed), lambda a: F.array_sort(F.filter(a, lambda p: p["k"] != "")))
    kept = F.transform(ordered, lambda a: F.filter(a, lambda p, i: (i == 0) | (F.get(a, i - 1)["k"] != p["k"])))
    back = F.transform(kept, lambda a: F.array_sort(F.transform(a, lambda p: F.struct(p["i"].alias("i"), p["t"].alias("t")))))
    return F.transform(F.get(back, F.lit(0)), lambda p: p["t"])


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def clean_note(c: Column) -> Column:
    """A note without dispatcher scaffold, boilerplate and repeated sentences; empty if little is left."""
    x = F.coalesce(c, F.lit(""))
    for p in K.SCAFFOLD:
        x = F.regexp_replace(x, p, "")
    x = F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    low = F.lower(x)
    empty = low.isin("", *K.MEANINGLESS) | reduce(lambda a, b: a | b, (F.startswith(low, F.lit(p)) for p in K.SYSTEM_PREFIXES)) | any_match(x, K.BOILERPLATE)
    said = F.filter(sentences(x), lambda s: ~any_match(s, K.BOILERPLATE))
    kept = F.array_join(first_sentences(said), " ")
    return F.when(empty | (F.length(F.regexp_replace(kept, r"(?U)\W", "")) < 8), "").otherwise(kept)


def is_maintenance(c: Column) -> Column:
    return (F.coalesce(c, F.lit("")) != "") & ~F.coalesce(any_match(c, K.NOT_MAINTENANCE), F.lit(False))


def _redact(c: Column, patterns) -> Column:
    """Struct of text, was_redacted, kinds. Each pattern goes over the text once.

    What a pattern finds never equals what it puts there: each replacement brings one "[", which no pattern matches, so
    a text is the same after a pattern only if nothing was found.
    """
    # one-element arrays bind what is made once and used twice; else the text of every step would be made again for each use
    def step(x: Column, kind: str, pattern: str, with_: str) -> Column:
        done = F.transform(x, lambda s: F.struct(s["text"].alias("before"), F.regexp_replace(s["text"], pattern, with_).alias("text"), s["kinds"].alias("kinds")))
        kinds = lambda s: F.when(s["before"] != s["text"], F.array_append(s["kinds"], F.lit(kind))).otherwise(s["kinds"])
        return F.transform(done, lambda s: F.struct(s["text"].alias("text"), kinds(s).alias("kinds")))

    x = F.array(F.struct(c.alias("text"), F.array().cast("array<string>").alias("kinds")))
    x = reduce(lambda x, p: step(x, *p), patterns, x)
    return F.get(F.transform(x, lambda s: F.struct(s["text"].alias("text"), (F.size(s["kinds"]) > 0).alias("was_redacted"), s["kinds"].alias("kinds"))), F.lit(0))


def redact_pii(c: Column) -> Column:
    """Struct of text, was_redacted, kinds: personal data replaced in a fixed order of patterns."""
    return _redact(c, K.PII)


def redact_external(c: Column) -> Column:
    """As ``redact_pii``, with addresses, places and coordinates."""
    return _redact(c, K.PII + K.EXTERNAL)


def unsafe_outside(c: Column, allowed: Column) -> Column:
    """Whether a text still holds an identifier once the allowed ones, longest first, are masked."""
    by_length = F.array_sort(allowed, lambda a, b: F.length(b) - F.length(a))
    masked = F.aggregate(by_length, c, lambda acc, x: F.replace(acc, x, F.lit("[ID]")))
    # masked once, not once a pattern
    return F.coalesce(F.exists(F.array(masked), lambda m: any_match(m, [p for _, p, _ in K.PII + K.EXTERNAL])), F.lit(False))


def screen(df: DataFrame, text: str, allowed: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may leave, rows that are held back)."""
    flagged = df.withColumn("_held", unsafe_outside(F.col(text), F.col(allowed)))
    return flagged.filter("NOT _held").drop("_held"), flagged.filter("_held").drop("_held")


#: fixed values: typographic characters and their ASCII forms; all other characters outside ASCII become a blank
FOLD = {"\u2013": "-", "\u2014": "-", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2026": "...", "\u00a0": " "}


def to_ascii(c: Column) -> Column:
    single = {k: v for k, v in FOLD.items() if len(v) == 1}
    for k, v in FOLD.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return F.regexp_replace(F.translate(c, "".join(single), "".join(single.values())), r"[^\x00-\x7F]", " ")


def chunks(df: DataFrame, text: str = "text", size: int = 900, step: int = 750, least: int = 40) -> DataFrame:
    """Overlapping windows of each page with blanks collapsed: adds chunk_no and chunk."""
    x = df.withColumn("_page", F.trim(F.regexp_replace(F.col(text), r"\s+", " "))).filter(F.length("_page") >= least)
    last = F.ceil(F.greatest(F.length("_page") - size, F.lit(0)) / F.lit(float(step))).cast("int")
    x = x.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    return x.withColumn("chunk", F.substring("_page", F.col("chunk_no") * step + 1, F.lit(size))).drop("_page")


def resolution_signal(c: Column) -> Column:
    return (
        F.when(has_term(c, K.CONFLICT_TERMS), "UNRESOLVED")
        .when(has_term(c, K.RESOLUTION_TERMS), "RESOLVED")
        .when(has_term(c, K.NO_ISSUE_TERMS), "NO_ISSUE_OBSERVED")
        .when(has_term(c, K.REPAIR_TERMS), "REPAIR_RECORDED")
        .otherwise("UNKNOWN")
    )


def note_patterns(c: Column) -> Column:
    return F.array_compact(F.array(*(F.when(has_term(c, terms), F.lit(name)) for name, terms in K.NOTE_PATTERNS.items())))


def direct_cause(notes: Column) -> Column:
    """The first sentence of an array of notes that states a cause and doesn't hedge it; null if there is none."""
    sentences = F.flatten(F.transform(notes, lambda n: F.split(n, r"\.")))

    def says(s: Column) -> Column:
        low = F.lower(s)
        hit = lambda phrases: reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in phrases))
        return hit(K.CAUSE_MARKERS) & ~hit(K.HEDGED_CAUSES)

    first = F.try_element_at(F.filter(sentences, says), F.lit(1))
    return F.concat(F.trim(first), F.lit("."))


def corpus_boilerplate(df: DataFrame, text: str = "text", share: float = K.BOILERPLATE_SHARE) -> DataFrame:
    """``df`` with is_boilerplate: short texts whose key recurs in a share of all rows, four at least."""
    keyed = df.withColumn("_key", text_key(F.coalesce(F.col(text), F.lit(""))))
    often = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    total = keyed.agg(F.count("*").alias("_all"))
    least = F.greatest(F.lit(K.BOILERPLATE_LEAST), F.floor(F.col("_all") * share))
    hit = often.crossJoin(F.broadcast(total)).filter((F.col("_n") >= least) & (F.length("_key") < K.BOILERPLATE_LENGTH)).select("_key", F.lit(True).alias("_hit"))
    return keyed.join(hit, "_key", "left").withColumn("is_boilerplate", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")
