"""Corpus preparation: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

``STAGES`` are applied in order to ``documents``; each stage's rows are written as Parquet to the
shared checkpoint folder and read again by the next one, so a stage's work survives lost executors and
no plan grows over several stages. All stages but the last return the columns of ``documents``; the
last returns one row per packed piece of a document.

Defined results: rows with null ids pass through all stages (see the operators for what they do
there); repeated rows count as near duplicates, so one stays; an empty table gives no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlens.llm import decontaminate, packing, quality_rules, simhash, suffix_dedup
from wattlens.session import scratch_path, ship_package

QUALITY_POLICY = "v1"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality policy."""
    ship_package(spark)
    return quality_rules.apply_policy(quality_rules.ledger(docs), QUALITY_POLICY).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    ship_package(spark)
    return simhash.representatives(docs, shingle=3, radius=2)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with smaller ids have; those of which nothing is left go."""
    ship_package(spark)
    rows = suffix_dedup.dedup(docs, as_text=True).where("n_removed = 0 OR n_removed < n_bytes")
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row per piece of a document, with its place."""
    ship_package(spark)
    return packing.pack(docs, as_array=True)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Several stages cannot be written as SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
