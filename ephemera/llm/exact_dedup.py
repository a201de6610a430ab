"""Operator 1, exact dedup: equal texts by 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, text_of, without_white


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = without_white,
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of docs: (id, keep_id, group_size, kept, text_sha256).

    Rows are equal when their normalised texts are equal byte for byte. The row with the most code points in
    the original text stays, then the smallest id. Rows are grouped by content_hash; each group also carries
    its least and greatest normalised text, which are combined before the shuffle and are equal exactly when
    no two texts of the group differ. In a group where they differ (a hash collision), rows are grouped
    by the whole text instead.

    Null texts count as empty; empty texts are equal to each other. Repeated rows with one id are all returned and
    all kept if that id stays. A null id sorts first. Other columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    norm = normalise(text_of(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.length(text_of(text_col)).alias("n"), norm.alias("norm"))
    keyed = rows.withColumn("key", content_hash(F.col("norm")))

    def keep() -> list[Column]:
        return [F.min(F.struct((-F.col("n")).alias("n"), F.col("id"))).alias("first"), F.count(F.lit(1)).alias("size")]

    groups = scratch.save(
        keyed.groupBy("key")
        .agg(*keep(), F.min("norm").alias("least"), F.max("norm").alias("most"))
        .select("key", "first", "size", (F.col("least") != F.col("most")).alias("mixed"))
    )
    # Both sides of this join have their own exchange, so that a hot key is split while it runs.
    told = keyed.select("id", "key", F.sha2("norm", 256).alias("sha"), "n").join(groups, "key")
    clean = told.where(~F.col("mixed")).select("id", "first", "size", "sha")
    out = clean
    if groups.where("mixed").limit(1).count():
        collided = keyed.join(groups.where("mixed").select("key"), "key", "left_semi")
        apart = collided.groupBy("norm").agg(*keep())
        out = clean.unionByName(collided.join(apart, "norm").select("id", "first", "size", F.sha2("norm", 256).alias("sha")))
    return out.select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("first.id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
