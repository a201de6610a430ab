"""The corpus pipeline: quality, line dedup, near dedup, source mix and packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ephemera.llm import line_dedup, mixing, near_dedup, packing, quality
from ephemera.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle when near-duplicates are dropped.
NEAR_WIDTH = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. A table without documents is returned as it is."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where(F.col("score") >= quality.KEEP).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are copies or near-copies of an earlier line, and documents whose every line that is not blank went."""
    left = line_dedup.dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_dropped") > 0) & (F.col("n_dropped") == F.col("n_lines"))
    return left.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, the one with the smallest id."""
    found = near_dedup.near_components(docs, width=NEAR_WIDTH)
    gone = Scratch(spark).save(found.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as the source mix reads them; none is left out."""
    return mixing.mix(docs.select(*COLUMNS), mixing.Target(repeats=mixing.REPEATS)).select(*COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; a document that the mix reads twice is packed twice."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("source mix", mix_stage),
    ("best-fit packing", pack_stage),
]

#: Learned scores, MinHash components and subset sums are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted when the next one is written."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written
    scratch.drop(docs)
    return packed
