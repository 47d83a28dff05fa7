"""Corpus pipeline: toxicity, near-duplicates, benchmark leaks, secrets, source mix; each stage reads what the last kept."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm import decontaminate, secret_scan, simhash_dedup, source_mix, toxicity
from vicinage.llm.common import table
from vicinage.session import fresh_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, learnt from all labelled ones among `docs`, rejects."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays, the one with the smallest id."""
    return simhash_dedup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars follows the text."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the training mix takes."""
    return source_mix.mix(docs).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "epochs", "taken")


STAGES = [("toxicity", toxicity_stage), ("simhash_near_dedup", near_duplicate_stage), ("benchmark_decontamination", benchmark_stage),
          ("secret_scan", secret_stage), ("source_mixing", mixing_stage)]

ORACLE_SQL = None  # the trained classifier, XXH64 fingerprints and hashed order have no SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again by the next."""
    docs, folder = table(spark, sf_dir, "documents"), fresh_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = os.path.join(folder, f"{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
