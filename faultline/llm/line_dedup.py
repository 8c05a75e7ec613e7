"""Line deduplication over levelled sorted runs of line hashes (operator 11).

A run is a table of (h1, h2, docs, hi): a line's hash of 128 bits, how many documents hold it (counted up to the number
that makes a line repeated) and the largest of their ids. Its files are buckets of the hash, sorted by it, so that runs
meet each other and new batches in merge joins that move neither. A batch of documents is reduced to one row for each
line, merge-anti-joins the runs (a line that a run has settled adds nothing) and what is left becomes a run of level 0.
As soon as a level holds ``FANOUT`` runs, they are merged into one of the next level. Lines are hashed once, where
texts are read; all else moves hashes, except one shuffle that brings texts and the places of their dropped lines together.

Only DataFrame functions take part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_folder, new_path, save, table

FANOUT = 2
#: Batches that a table is dealt into, by ranges of ids, largest first: the first run that holds a line knows its owner.
BATCHES = 4
SHORTEST, LEAST = 20, 3
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a missing id: rows without one are one document, that ranks below all others.
NO_ID = -(1 << 63)


class LineRuns:
    """The runs of lines seen so far; ``add`` takes a batch of (h1, h2, doc), ``repeated`` tells the lines that repeat.

    Batches share no document. A line is repeated when at least ``least`` documents hold it.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST, fanout: int = FANOUT):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []  # names and folders of runs, by level

    def _write(self, run: DataFrame) -> tuple[str, str]:
        path = new_path(self.spark, "line-run")
        name = path.rpartition("/")[2].replace("-", "_")
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name, path

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.withColumnsRenamed({"docs": "b_docs", "hi": "b_hi"})
            docs = F.least(F.lit(self.least), F.coalesce("docs", F.lit(0)) + F.coalesce("b_docs", F.lit(0)))
            return a.join(b.hint("merge"), ["h1", "h2"], "full_outer").select("h1", "h2", docs.alias("docs"), F.greatest("hi", "b_hi").alias("hi"))

        return reduce(merge, (self.spark.table(n) for n, _ in runs))

    def add(self, batch: DataFrame) -> None:
        docs = F.least(F.lit(self.least), F.count_distinct("doc").cast("int"))
        new = batch.groupBy("h1", "h2").agg(docs.alias("docs"), F.max("doc").alias("hi"))
        for name, _ in (r for level in self.levels for r in level):
            settled = self.spark.table(name).filter(F.col("docs") >= self.least).select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.col("hi").alias("s_hi"))
            new = new.join(settled.hint("merge"), (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")) & (F.col("s_hi") > F.col("hi")), "left_anti")
        self._put(self._write(new), 0)

    def _put(self, run: tuple[str, str], level: int) -> None:
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        own = self.levels[level]
        own.append(run)
        if len(own) == self.fanout:
            merged = self._write(self._merged(own))
            self._drop(own)
            self.levels[level] = []
            self._put(merged, level + 1)

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_folder(self.spark, path)

    def repeated(self) -> DataFrame:
        """(h1, h2, hi) of every repeated line: hi is the largest id that holds it."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs).filter(F.col("docs") >= self.least).select("h1", "h2", "hi")

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def line_key(line: Column) -> Column:
    """What tells lines apart: blanks stripped at both ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _own(doc_id: str, text: str) -> list[Column]:
    """A row's id and a hash of its text: rows of one id and one text have the same lines in the same places."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("line_doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("line_text")]


def dropped_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = SHORTEST, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(line_doc, line_text, gone) of documents that lose lines: places (from 0) of the lines that go, ascending."""
    spark = docs.sparkSession
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    bounds = docs.agg(F.percentile_approx(doc, [k / batches for k in range(1, batches)], 10_000).alias("b")).first().b if batches > 1 else []
    batch = sum((F.when(doc <= b, 1).otherwise(0) for b in bounds or []), F.lit(0))
    lines = docs.select(*_own(doc_id, text), batch.alias("batch"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= shortest)
    lines = lines.select("line_doc", "line_text", "line_no", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"), "batch")
    path = new_path(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, least, fanout)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b).select("h1", "h2", F.col("line_doc").alias("doc")))
    repeated = save(runs.repeated(), "repeated-lines")
    runs.close()
    # a line that a third of all rows hold is dealt out by adaptive execution: neither side is bucketed here
    hits = lines.join(repeated.hint("merge"), ["h1", "h2"]).filter("hi <> line_doc")
    return save(hits.groupBy("line_doc", "line_text").agg(F.sort_array(F.collect_set("line_no")).alias("gone")), "dropped-lines")


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = SHORTEST, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text): every row of ``docs`` as a struct, and its text without repeated lines.

    A line is repeated if its key (blanks stripped, A-Z in lower case) has ``shortest`` code points or more and
    ``least`` documents or more hold it; it stays in the one with the largest id, as often as that holds it, and goes
    elsewhere. Null and empty texts are one empty line. Rows of one id are one document: lines are counted once for it.
    Rows without an id are one document, that ranks below all ids. A row given twice comes out twice. Long texts are
    split in their row. An empty table gives no rows. ``row`` keeps all columns, whatever their names.
    """
    gone = dropped_lines(docs, text, doc_id, shortest, least, batches, fanout).withColumnsRenamed({"line_doc": "g_doc", "line_text": "g_text"})
    rows = docs.select(F.struct("*").alias("row"), *_own(doc_id, text), F.coalesce(text, F.lit("")).alias("body"))
    x = rows.join(gone.hint("merge"), (F.col("line_doc") == F.col("g_doc")) & (F.col("line_text") == F.col("g_text")), "left")
    x = x.withColumn("lines", F.split("body", "\n"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n"))
    n_lines, n_dropped = F.size("lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return x.select("row", n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), kept.alias("kept_text"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
k AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM l),
y AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '{UPPER}', '{LOWER}') AS key FROM k),
r AS (SELECT key, max(doc_id) AS hi FROM y WHERE length(key) >= {SHORTEST} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST}),
m AS (SELECT doc_id, line, i, coalesce(doc_id <> hi, false) AS gone FROM y LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
