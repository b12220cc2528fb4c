"""The corpus pipeline over `documents`: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes what its predecessor kept, in the columns of documents, and all but the last return those. Stages reject
or shorten documents as their operators' docstrings say, nulls and repeated rows included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontamination, jaccard_join, line_dedup, packing, quality, scratch, tokens

_HAS_WORD = r"[^\x20\x09-\x0D]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees pass; the trees learn from the labelled ones among docs."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.judge(docs, model)
    return judged.where("_quality_kept").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of three lines, or of fewer that hold 50 words; those of which no word is left go. n_chars follows the text."""
    found = line_dedup.dedup(docs, run=3, words=50)
    emptied = (F.col("_line_removed") > 0) & ~F.col("_line_kept_text").rlike(_HAS_WORD)
    text = F.when(F.col("_line_removed") > 0, F.col("_line_kept_text")).otherwise(F.col("text"))
    kept = found.where(~emptied).withColumn("text", text)
    return kept.withColumn("n_chars", F.when(F.col("_line_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles with a similarity of 0.8 link: the one with the smallest id."""
    return jaccard_join.keep_first(docs, n=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return packing.pack(docs, tokens.default_path())


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup_stage), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("packing", pack)]

#: Trees and tokenizers aren't SQL: the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
