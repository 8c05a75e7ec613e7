"""Exact deduplication by distributed MSD radix partitioning (operator 10).

Texts are bytes. A round takes the next digit (a run of successive bytes) of every text that is still in a
group of two or more and splits each group by it. A group leaves when one text is left in it or when its texts
have ended; texts in one ended group agree in every byte, so equality needs no digest. Digits grow from round to
round, in the end by doubling, and a round carries only the bytes that none has looked at: texts of L equal bytes take
a number of rounds that grows with the logarithm of L, and write no more than L bytes in all but a constant.

A round is a counting aggregate (combined before the shuffle, so a group with a third of all rows costs one row a
task) and an inner join that keeps the members of groups of two or more (adaptive execution splits a hot key).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import save, table, utf8

#: Bytes that the first rounds look at; each later one looks at twice as many as the one before.
DIGITS = (192, 2048, 16384, 131072)


def radix_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digits: tuple[int, ...] = DIGITS) -> DataFrame:
    """Members of every group of two or more equal texts: doc_id, sha256, keep_id (largest id), group_size.

    Null texts are equal to empty ones. No row for a text that occurs once. A group's number comes from the saved
    table of the round that split it, so that groups stay apart whatever ids they hold: one id with two texts, or none.
    """
    live = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(-1).cast("long").alias("node"), utf8(text).alias("body"))
    done: DataFrame | None = None
    for at in count():
        width = digits[at] if at < len(digits) else 2 * width
        dealt = live.withColumn("digit", F.substring("body", 1, width))
        split = dealt.groupBy("node", "digit").agg(F.count("*").alias("n"), F.max("doc_id").alias("hi")).filter("n > 1")
        split = save(split.withColumn("group", F.monotonically_increasing_id()), f"split{at}").withColumnsRenamed({"node": "in_node", "digit": "by"})
        # the size of a file says little of what it holds in memory, so nothing that grows is broadcast by it
        kept = dealt.join(split.hint("merge"), (F.col("node") == F.col("in_node")) & (F.col("digit") == F.col("by")))
        ended = F.octet_length("digit") < width
        kept = save(
            kept.select(
                "doc_id",
                ended.alias("ended"),
                F.col("group").alias("node"),
                "hi",
                F.col("n").alias("group_size"),
                # the first round has whole texts
                (F.col("sha256") if at else F.sha2("body", 256)).alias("sha256"),
                F.when(~ended, F.expr(f"substring(body, {width + 1})")).alias("body"),
            ),
            f"radix{at}",
        )
        part = kept.filter("ended").select("doc_id", "sha256", F.col("hi").alias("keep_id"), "group_size")
        done = part if done is None else done.unionByName(part)
        live = kept.filter("NOT ended").select("doc_id", "node", "body", "sha256")
        if live.isEmpty():
            return done
    raise AssertionError


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digits: tuple[int, ...] = DIGITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. Null counts as empty. A row given twice with one id is
    one document: both copies count in group_size and carry the same verdict. One id with two texts is two documents.
    Rows without an id that share their text with no row that has one are kept, with a null keep_id. An empty table
    gives no rows.
    """
    classes = radix_classes(docs, text, doc_id, digits).dropDuplicates(["doc_id", "sha256"])
    c = classes.select(F.col("doc_id").alias("c_id"), F.col("sha256").alias("c_sha"), "keep_id", "group_size")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(utf8(text), 256).alias("text_sha256"))
    j = d.join(c.hint("merge"), d.doc_id.eqNullSafe(c.c_id) & (d.text_sha256 == c.c_sha), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return j.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def without_rows(docs: DataFrame, gone: DataFrame, again: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone``, and one row of each (id, text) of ``again``; all columns stay.

    Both tables hold (gone_id, gone_sha): the null-safe id and the SHA-256 of the text as UTF-8, null as empty.
    """
    # the row travels as one column, so that no name of docs can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.sha2(utf8("text"), 256).alias("own_sha"))
    same = F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_sha") == F.col("gone_sha"))
    left = rows.join(gone.hint("merge"), same, "left_anti")
    if not again.isEmpty():
        again = again.hint("merge")
        once = left.join(again, same, "left_semi").groupBy("own_id", "own_sha").agg(F.first("row").alias("row"))
        left = left.join(again, same, "left_anti").unionByName(once.select("row", "own_id", "own_sha"))
    return left.select("row.*")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each distinct text, that with the largest doc_id; all columns stay.

    Null counts as empty. Rows without an id give way to rows with one. Of rows that repeat id and text, or of rows
    without an id, any one stays. One id with two texts is two documents. An empty table gives no rows.
    """
    classes = radix_classes(docs).withColumn("stays", F.col("keep_id").eqNullSafe(F.col("doc_id")))
    key = [F.col("doc_id").alias("gone_id"), F.col("sha256").alias("gone_sha")]
    counted = save(classes.groupBy(*key, "stays").agg(F.count("*").alias("n")), "exact")
    return without_rows(docs, counted.filter("NOT stays").select("gone_id", "gone_sha"), counted.filter("stays AND n > 1").select("gone_id", "gone_sha"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)
"""
