"""One query for each text operator, with production parameters, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, centroids, html_text, line_dedup, mixing, near_dedup, phrases, pii, quality_model, quality_rules, sharding, vector_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), ranks_path())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), link=(85, 100)).drop("text_hash")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [pii.count_kind("base", n).cast("long").alias(f"n_{k}") for n, k in enumerate(pii.KINDS)]
    every = F.sort_array(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(every).alias("spans"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.drop("score")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters_digest(table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": op1_bpe, "op2_line_dedup": op2_line_dedup, "op3_near_dedup": op3_near_dedup, "op4_mixing": op4_mixing, "op5_pii": op5_pii, "op6_quality_rules": op6_quality_rules, "op7_quality_model": op7_quality_model, "op8_html_text": op8_html_text, "op9_sharding": op9_sharding, "op10_nearest": op10_nearest, "op11_near_vectors": op11_near_vectors, "op12_centroids": op12_centroids, "op13_phrases": op13_phrases}

ORACLE_SQL = {"op2_line_dedup": line_dedup.LINE_SQL, "op3_near_dedup": near_dedup.NEAR_SQL, "op4_mixing": mixing.MIX_SQL, "op10_nearest": ann.ANN_SQL, "op11_near_vectors": vector_dedup.VECTOR_SQL, "op12_centroids": centroids.CENTROID_SQL, "op13_phrases": phrases.PHRASE_SQL}
