"""Documents to token ids: quality, line dedup, near-dedup, mixing, encoding. Each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from esig.llm import bpe, line_dedup, mixing, near_dedup, quality_model
from esig.llm.queries import ranks_path
from esig.llm.util import stage_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.score(docs.select(*COLUMNS), labels).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others share; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, keep=("lang", "source")).withColumnRenamed("kept_text", "text")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with proof that they decode to its text."""
    coded = bpe.encode_bpe(docs.select("doc_id", "source", "text"), ranks_path(), exact="exact")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixed), ("bpe", tokens)]
#: The classifier's scores have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
