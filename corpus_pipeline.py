"""A pipeline for training data: each stage takes the documents that the one before it kept.

``run`` writes every stage's result as Parquet to the shared folder and reads it back for the next, and removes it when
that one is written: only the last stage's table stays. Texts are redacted in place, so a stage's columns are
those of ``documents``; the last returns the corpus itself, a row for each document that the mix takes, with the number of
words taken, repeats counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.llm.common import new_path, remove, stored, table
from echolith.llm.decontamination import is_clean
from echolith.llm.quality_classifier import keep_good
from echolith.llm.secret_scan import redact_secrets
from echolith.llm.simhash_dedup import keep_one
from echolith.llm.source_mix import mix

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return docs.where(is_clean(docs, table(spark, sf_dir, "benchmark")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes."""
    return mix(docs, keep=True).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
]

#: Fingerprints, trees and alignments have no SQL; tests hold the pipeline against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = new_path(spark)
        docs = stored(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return docs
