"""The corpus pipeline over ``documents``: quality rules, line dedup, near duplicates, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcomelens.llm import byte_bpe, decontamination, fertility, jaccard, line_templates
from outcomelens.llm.queries import BYTE_RANKS, PIECE_MODEL
from outcomelens.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but those with an id (null counts as one) in the first column of ``ids``."""
    gone = ids.toDF("_gone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged. Of rows with one id all stay or go: they go if one is rejected."""
    docs = docs.select(COLUMNS)
    verdicts = fertility.judge(docs, "doc_id", "text", PIECE_MODEL, "lang")
    return without(docs, verdicts.where(~F.col("kept")).select("doc_id"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines but their first are taken out; documents that lose their last word by that go. ``n_chars`` follows."""
    left = line_templates.drop_recurring(docs.select(COLUMNS))
    left = left.where((F.col("_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    chars = F.when(F.col("_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", chars).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays."""
    groups = jaccard.link(docs.select(COLUMNS))
    return without(docs.select(COLUMNS), groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    found = decontamination.find(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs.select(COLUMNS), found.select("doc_id").distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of the ids and of the text decoded from them."""
    return byte_bpe.round_trip(docs, "doc_id", "text", BYTE_RANKS, ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("encode", encode)]

#: Vocabularies, template trees and alignments are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        place = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
