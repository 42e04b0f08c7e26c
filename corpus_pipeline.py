"""The corpus pipeline: quality, toxicity, near copies, secrets, packing.

Each stage reads what its predecessor wrote. ORACLE_SQL is None: no stage but the secret scan can be said in SQL;
tests/llm compares the stages with brute-force versions.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findings_engine.llm import near_copies, packing, quality, secrets_scan, toxicity
from findings_engine.llm.common import free_name, remove, shared_dir, table

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds to be of good quality."""
    return quality.keep(docs, quality.train_on(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic."""
    return toxicity.keep(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels")))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near copies."""
    return near_copies.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars of the new text."""
    base, found = free_name("base", docs.columns), free_name("found", docs.columns)
    spans, masked = F.col(found), F.size(found) > 0
    rows = secrets_scan.scan(docs, base=base, found=found)
    rows = rows.withColumn("text", F.when(masked, secrets_scan.redacted(F.col("text"), spans)).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.when(masked, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_copies", near_copies_stage), ("secrets", secrets_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's folder goes when the next one is written, the last when the driver's process ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        atexit.register(remove, spark, path)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
