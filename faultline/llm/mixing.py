"""Mixing sources to target weights by iterative proportional fitting (operator 1).

Documents are counted into cells (source, language, topic). Every category outside the targets is folded into
``other``, so the number of cells is bounded by the targets alone, whatever the corpus size; that bound makes the
one-partition fitting and the broadcast of the fitted cells safe. Raking scales the cells' token weights to one
marginal after another; a closed-form calibration then turns weights into probabilities with the asked-for
expected number of tokens, and a hash of the id samples the documents. Cells whose weight asks for more tokens than
they hold are resampled: their documents are repeated, so that the expected shares of what is kept are the raked ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

OTHER = "other"

#: Token shares aimed at. A category that has no tokens gives its share to the others in proportion.
TARGETS: dict[str, dict[str, float]] = {
    "source": {"src0": 0.24} | {f"src{i}": 0.04 for i in range(1, 20)},
    "lang": {"en": 0.58, "fr": 0.16, "de": 0.16, "es": 0.10},
    "topic": {"legal": 0.05, "contact": 0.05, "tabular": 0.08, "general": 0.82},
}
#: Topics are told by word lists, not by a model: the first rule with one of its marks in the lower-cased text, else
#: general. They are a parameter of the corpus at hand, as the targets are.
TOPIC_MARKS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("legal", ("licensed under", "all rights reserved", "copyright")),
    ("contact", ("@example.", "@mail.", "password")),
    ("tabular", (" | ",)),
)
ROUNDS = 12
KEEP_TOKENS = 0.9
SEED = "mix-1"


def topic_of(text: F.Column) -> F.Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for name, marks in TOPIC_MARKS:
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(low, F.lit(m))
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit("general"))


def tokens_of(text: F.Column) -> F.Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, rounded up, and one for the end of the document."""
    return (F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / F.lit(4.0)) + 1).cast("long")


def unit_hash(doc_id: F.Column, seed: str) -> F.Column:
    """A uniform number in [0, 1) from the id and the seed alone."""
    h = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(16**12))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int = ROUNDS, keep_other: bool = False) -> DataFrame:
    """Iterative proportional fitting: ``cells`` (the target columns, tokens) gains ``weight``, which sums to 1.

    With ``keep_other``, ``other`` keeps its share of the tokens in each margin for which no target of it is given,
    and the targets share what is left.
    All windows run over one partition; ``cells`` must be bounded by the targets, as ``mix_sources`` makes it.
    """
    out = cells.coalesce(1).withColumn("weight", F.col("tokens").cast("double"))
    for c, shares in targets.items():
        aim = F.lit(0.0)
        for k, v in reversed(shares.items()):
            aim = F.when(F.col(c) == k, F.lit(float(v))).otherwise(aim)
        out = out.withColumn(f"aim_{c}", aim)
        # the share of present categories, each counted once
        first = F.row_number().over(Window.partitionBy(c).orderBy(*targets)) == 1
        out = out.withColumn(f"one_{c}", F.when(first, F.col(f"aim_{c}")).otherwise(0.0))
    for c in targets:
        out = out.withColumn(f"aim_{c}", F.try_divide(F.col(f"aim_{c}"), F.sum(f"one_{c}").over(Window.partitionBy(F.lit(1)))))
        if keep_other and OTHER not in targets[c]:
            tokens, one = F.col("tokens").cast("double"), Window.partitionBy(F.lit(1))
            rest = F.coalesce(F.try_divide(F.sum(F.when(F.col(c) == OTHER, tokens).otherwise(0.0)).over(one), F.sum(tokens).over(one)), F.lit(0.0))
            out = out.withColumn("rest", rest).withColumn(f"aim_{c}", F.when(F.col(c) == OTHER, F.col("rest")).otherwise(F.col(f"aim_{c}") * (1.0 - F.col("rest"))))
    for _ in range(rounds):
        for c in targets:
            have = F.sum("weight").over(Window.partitionBy(c))
            out = out.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"aim_{c}"), have), F.lit(0.0)))
    whole = F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("weight", F.coalesce(F.try_divide(F.col("weight"), whole), F.lit(0.0))).select(*targets, "tokens", "weight")


def calibrate(cells: DataFrame, keep_tokens: float) -> DataFrame:
    """Adds ``probability`` = min(1, rate) and ``rate`` = c * weight / tokens, the expected copies of a document.

    c is such that keep_tokens of all tokens are expected without their copies. Cells in ascending order of
    tokens / weight reach 1 first; c follows from running sums. Tokens times rate has the shares of the weights
    exactly. If the cells with any weight hold fewer tokens than asked for, each of them gets probability 1 and a
    rate of 1 or more, with c the number of tokens asked for; only then do the shares fall short.
    """
    order = (F.try_divide(F.col("tokens").cast("double"), F.col("weight")).asc_nulls_last(), *(c for c in cells.columns if c not in ("tokens", "weight")))
    up_to = Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(1))
    out = cells.withColumn("ratio", F.try_divide(F.col("tokens").cast("double"), F.col("weight")))
    out = out.withColumn("t_before", F.sum("tokens").over(up_to) - F.col("tokens")).withColumn("w_after", 1.0 - F.sum("weight").over(up_to) + F.col("weight"))
    want = F.lit(float(keep_tokens)) * F.sum("tokens").over(whole)
    c_here = F.try_divide(want - F.col("t_before"), F.col("w_after"))
    out = out.withColumn("c_here", F.when(F.col("weight") > 0, c_here))
    # the first cell that its own c leaves below 1 settles c for itself and all after it
    fits = F.when((F.col("weight") > 0) & (F.col("c_here") <= F.col("ratio")), F.col("ratio"))
    out = out.withColumn("from_ratio", F.min(fits).over(whole))
    c = F.max(F.when(F.col("ratio") == F.col("from_ratio"), F.col("c_here"))).over(whole)
    out = out.withColumn("c", c)
    p = F.when(F.col("weight") <= 0, 0.0).when(F.col("from_ratio").isNull(), 1.0).when(F.col("ratio") < F.col("from_ratio"), 1.0).otherwise(F.least(F.lit(1.0), F.col("c") / F.col("ratio")))
    rate = F.when(F.col("weight") <= 0, 0.0).when(p < 1, p).otherwise(F.greatest(F.lit(1.0), F.coalesce("c", want) / F.col("ratio")))
    return out.withColumn("probability", p).withColumn("rate", rate).drop("ratio", "t_before", "w_after", "c_here", "from_ratio", "c")


def _mixed(docs: DataFrame, targets, keep_tokens: float, rounds: int, seed: str, text: str, doc_id: str, keep_other: bool) -> DataFrame:
    """``docs`` as the column row, with the columns that mixing adds."""
    targets = targets or TARGETS
    # the row travels as one column, so that no name of docs can clash
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col("source").alias("raw_source"), F.col("lang").alias("raw_lang"))
    columns = {"source": F.col("raw_source"), "lang": F.col("raw_lang"), "topic": topic_of(F.col("text"))}
    placed = rows.withColumn("mix_tokens", tokens_of(F.col("text")))
    for c, shares in targets.items():
        placed = placed.withColumn(f"mix_{c}", F.when(columns[c].isin(*shares), columns[c]).otherwise(F.lit(OTHER)))
    cells = placed.groupBy(*(F.col(f"mix_{c}").alias(c) for c in targets)).agg(F.sum("mix_tokens").alias("tokens"))
    fitted = calibrate(rake(cells, targets, rounds, keep_other), keep_tokens)
    fitted = fitted.select(*(F.col(c).alias(f"mix_{c}") for c in targets), F.col("weight").alias("mix_weight"), F.col("probability").alias("mix_probability"), F.col("rate").alias("mix_rate"))
    # bounded by the targets: (categories + 1) multiplied over the margins
    out = placed.join(F.broadcast(fitted), [f"mix_{c}" for c in targets])
    unit, whole = unit_hash(F.col("id"), seed), F.floor("mix_rate")
    copies = whole + (unit < F.col("mix_rate") - whole).cast("long")
    return out.withColumn("mix_sampled", unit < F.col("mix_probability")).withColumn("mix_copies", copies)


def mix_sources(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep_tokens: float = KEEP_TOKENS, rounds: int = ROUNDS, seed: str = SEED, text: str = "text", doc_id: str = "doc_id", keep_other: bool = False
) -> DataFrame:
    """``docs`` with mix_source, mix_lang, mix_topic, mix_tokens, mix_weight, mix_probability, mix_rate, mix_sampled and mix_copies.

    mix_weight is the raked share of the document's cell, and mix_copies how often the document is taken: 0 if it
    isn't sampled, mix_rate on average. Nulls and categories without a target count as
    ``other``. Its target is its own share of the tokens with ``keep_other``, as in op1 and the pipeline; without, it is
    0 unless given, and such documents get probability 0. Null texts count as empty.
    Repeated rows with one id share one decision. Columns of ``docs`` under these names are replaced; ``keep_sampled``
    hands them back. An empty table gives an empty result.
    """
    mixed = _mixed(docs, targets, keep_tokens, rounds, seed, text, doc_id, keep_other)
    added = [*(f"mix_{c}" for c in (targets or TARGETS)), "mix_tokens", "mix_weight", "mix_probability", "mix_rate", "mix_sampled", "mix_copies"]
    return mixed.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in added), *added)


def keep_sampled(docs: DataFrame, targets=None, keep_tokens: float = KEEP_TOKENS, rounds: int = ROUNDS, seed: str = SEED, keep_other: bool = True) -> DataFrame:
    """The sampled rows of ``docs``, each as often as mix_copies says, with the columns of ``docs`` as they were."""
    mixed = _mixed(docs, targets, keep_tokens, rounds, seed, "text", "doc_id", keep_other).filter("mix_sampled")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select("row.*")


def margins(mixed: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """How a result of ``mix_sources`` meets its targets: margin, category, target, have, expected, taken (token shares).

    A row for every category of the targets and every category found. ``have`` 0 tells a target that no token can
    meet; its share goes to the others in proportion.
    """
    targets = targets or TARGETS
    spark = mixed.sparkSession
    aims = spark.createDataFrame([(m, k, float(v)) for m, shares in targets.items() for k, v in shares.items()], "margin string, category string, target double")
    sums = mixed.groupBy(*(f"mix_{m}" for m in targets)).agg(F.sum("mix_tokens").alias("t"), F.sum(F.col("mix_tokens") * F.col("mix_rate")).alias("e"), F.sum(F.col("mix_tokens") * F.col("mix_copies")).alias("c"))
    each = sums.select(F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(f"mix_{m}").alias("category"), "t", "e", "c") for m in targets))).alias("x")).select("x.*")
    each = each.groupBy("margin", "category").agg(F.sum("t").alias("t"), F.sum("e").alias("e"), F.sum("c").alias("c"))
    whole = each.groupBy("margin").agg(F.sum("t").alias("wt"), F.sum("e").alias("we"), F.sum("c").alias("wc"))
    share = each.join(whole, "margin").select("margin", "category", *(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)).alias(n) for a, b, n in (("t", "wt", "have"), ("e", "we", "expected"), ("c", "wc", "taken"))))
    return aims.join(share, ["margin", "category"], "full").select("margin", "category", F.coalesce("target", F.lit(0.0)).alias("target"), *(F.coalesce(n, F.lit(0.0)).alias(n) for n in ("have", "expected", "taken")))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), keep_other=True)
    return out.select(
        "doc_id", "mix_source", "mix_lang", "mix_topic", F.col("mix_tokens").alias("tokens"), F.round("mix_weight", 8).alias("weight"),
        F.round("mix_probability", 8).alias("probability"), F.col("mix_sampled").alias("sampled"), F.round("mix_rate", 6).alias("rate"), F.col("mix_copies").alias("copies"),
    )


def mix_sql(docs: str = "documents") -> str:
    """DuckDB SQL: every document of ``docs`` with its cell, raked weight, probability and decision."""

    def aim(c: str) -> str:
        return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in TARGETS[c].items()) + " ELSE 0.0 END"

    names = ", ".join(TARGETS)
    topic = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in TOPIC_MARKS) + " ELSE 'general' END"
    placed = ", ".join(f"CASE WHEN {x} IN ({', '.join(repr(k) for k in TARGETS[c])}) THEN {x} ELSE '{OTHER}' END AS {c}" for c, x in (("source", "source"), ("lang", "lang"), ("topic", f"({topic})")))
    parts = [
        f"placed AS (SELECT doc_id, {placed}, CAST(ceil(strlen(coalesce(text, '')) / 4.0) + 1 AS BIGINT) AS tokens FROM {docs})",
        f"cells AS (SELECT {names}, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS DOUBLE) AS weight FROM placed GROUP BY ALL)",
        "aims AS (SELECT *, " + ", ".join(f"({aim(c)}) / nullif((SELECT sum(a) FROM (SELECT DISTINCT {c}, {aim(c)} AS a FROM cells)), 0) AS aim_{c}" for c in TARGETS) + " FROM cells)",
    ]
    last = "aims"
    for r in range(ROUNDS):
        for c in TARGETS:
            parts.append(f"r{r}_{c} AS (SELECT * REPLACE (coalesce(weight * aim_{c} / nullif(sum(weight) OVER (PARTITION BY {c}), 0), 0) AS weight) FROM {last})")
            last = f"r{r}_{c}"
    order = f"(CASE WHEN weight > 0 THEN tokens / weight END) ASC NULLS LAST, {names}"
    parts += [
        f"w AS (SELECT * REPLACE (coalesce(weight / nullif(sum(weight) OVER (), 0), 0) AS weight) FROM {last})",
        f"s AS (SELECT *, CASE WHEN weight > 0 THEN tokens / weight END AS ratio, sum(tokens) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) - tokens AS t_before, 1.0 - sum(weight) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) + weight AS w_after FROM w)",
        f"h AS (SELECT *, CASE WHEN weight > 0 THEN ({KEEP_TOKENS} * sum(tokens) OVER () - t_before) / nullif(w_after, 0) END AS c_here FROM s)",
        "f AS (SELECT *, min(CASE WHEN c_here <= ratio THEN ratio END) OVER () AS from_ratio FROM h)",
        "k AS (SELECT *, max(CASE WHEN ratio = from_ratio THEN c_here END) OVER () AS c FROM f)",
        "p AS (SELECT *, CASE WHEN weight <= 0 THEN 0.0 WHEN from_ratio IS NULL THEN 1.0 WHEN ratio < from_ratio THEN 1.0 ELSE least(1.0, c / ratio) END AS probability FROM k)",
        f"q AS (SELECT *, CASE WHEN weight <= 0 THEN 0.0 WHEN probability < 1 THEN probability ELSE greatest(1.0, coalesce(c, {KEEP_TOKENS} * sum(tokens) OVER ()) / ratio) END AS rate FROM p)",
        f"v AS (SELECT d.*, q.weight, q.probability, q.rate, CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) / {float(16**12)!r} AS unit FROM placed d JOIN q USING ({names}))",
        "mixed AS (SELECT *, unit < probability AS sampled, CAST(floor(rate) + CASE WHEN unit < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM v)",
    ]
    return "WITH " + ",\n".join(parts) + "\n"


OP1_SQL = mix_sql() + "SELECT doc_id, source AS mix_source, lang AS mix_lang, topic AS mix_topic, tokens, round(weight, 8) AS weight, round(probability, 8) AS probability, sampled, round(rate, 6) AS rate, copies FROM mixed"
