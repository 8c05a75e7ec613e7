"""Manifests of tables: a tree of digests over key ranges, so that a check names the range that differs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import guard_calibration
from .store import materialise

FAN = 16


def leaves(df: DataFrame, key: str, width: int) -> DataFrame:
    """(range, rows, digest): for each ``width`` of an integer key, how many rows there are and the sum of their digests.

    A row's digest is 60 bits of the SHA-256 of its columns as text, by name, null marked apart from empty; sums don't
    depend on order. Rows without a key are range -1, keys below 0 are not expected.
    """
    text = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(df.columns)))
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    at = F.coalesce(F.floor(F.col(f"`{key}`") / F.lit(width)).cast("long"), F.lit(-1))
    return df.groupBy(at.alias("range")).agg(F.count("*").alias("rows"), F.sum(digest).alias("digest"))


def tree(df: DataFrame, key: str, width: int, fan: int = FAN) -> DataFrame:
    """(level, range, rows, digest): the leaves (level 0, digests of their sums), and above them digests of ``fan`` neighbours
    each, up to one root. Every level is a fold of the one below, a ``fan``-th of its size."""
    text = lambda c: F.col(c).cast("string")
    level = leaves(df, key, width).select(F.lit(0).alias("level"), "range", "rows", F.sha2(F.concat_ws(":", text("range"), text("rows"), text("digest")), 256).alias("digest"))
    # ranges from 0 on, so that division by the fan ends at one root
    level = level.withColumn("range", F.col("range") + 1)
    level = materialise(level, "leaves")
    out, n, k = level.withColumn("range", F.col("range") - 1), level.agg(F.max("range")).first()[0], 0
    if n is None:
        return out
    while n > 0 or k == 0:
        k, n = k + 1, n // fan
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "digest"))), lambda c: c["digest"]), "")
        level = level.groupBy(F.floor(F.col("range") / F.lit(fan)).cast("long").alias("range")).agg(F.sum("rows").alias("rows"), F.sha2(children, 256).alias("digest")).select(F.lit(k).alias("level"), "range", "rows", "digest")
        out = out.unionByName(level)
    return out


def write_manifest(df: DataFrame, path: str, key: str, width: int, fan: int = FAN) -> None:
    """Store a table's tree, with the width and fan that a check has to use."""
    tree(df, key, width, fan).withColumns({"key": F.lit(key), "width": F.lit(width).cast("long"), "fan": F.lit(fan)}).write.parquet(path)


def differing_ranges(df: DataFrame, path: str) -> DataFrame:
    """(first, past, stored_rows, rows): the key ranges in which a table isn't what its manifest says; none if it is.

    Only where the roots differ are leaves compared.
    """
    stored = df.sparkSession.read.parquet(path)
    facts = stored.first()
    if facts is None:
        raise ValueError(f"{path} is no manifest")
    now = tree(df, facts.key, facts.width, facts.fan)
    old, new = (x.filter("level = 0").select("range", F.col("rows").alias(n), F.col("digest").alias(f"{n}_d")) for x, n in ((stored, "stored_rows"), (now, "rows")))
    both = old.join(new, "range", "full_outer").filter(~F.col("stored_rows_d").eqNullSafe(F.col("rows_d")))
    return both.select((F.col("range") * facts.width).alias("first"), ((F.col("range") + 1) * facts.width).alias("past"), F.coalesce("stored_rows", F.lit(0)).alias("stored_rows"), F.coalesce("rows", F.lit(0)).alias("rows"))


def root(manifest: DataFrame) -> str:
    return manifest.orderBy(F.desc("level")).select("digest").first().digest


def dataset_id(spark: SparkSession, manifests: dict[str, str]) -> str:
    """Sixteen hex digits over the roots of stored manifests, by table."""
    return hashlib.sha256("".join(f"{n}:{root(spark.read.parquet(p))};" for n, p in sorted(manifests.items())).encode()).hexdigest()[:16]


def trusted_calibration(artifact: dict, tables: dict[str, DataFrame], manifests: dict[str, str], operational: bool = True) -> str:
    """The dataset's id, once every table is what its manifest says and the calibration is one of this dataset.

    Raises with the table and the key range that differ, or with the guard's reason.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in sorted(tables.items()):
        bad = differing_ranges(df, manifests[name]).orderBy("first").first()
        if bad is not None:
            raise ValueError(f"{name} isn't what its manifest says: keys from {bad.first} to {bad.past} have {bad.rows} rows, {bad.stored_rows} in the manifest, or other contents")
    own = dataset_id(spark, manifests)
    if artifact.get("dataset_id") is None:
        raise ValueError("the artifact names no dataset")
    guard_calibration(artifact, operational, own)
    return own
