"""A corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, secret scans, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm import decontaminate, neardup, packing, quality, secrets, storage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects."""
    scored = quality.train_and_classify(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("accepted").select(*docs.columns)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity 0.8 or more."""
    return neardup.drop_near_duplicates(docs, words=5, percent=80)


def _leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with ten consecutive words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.piece_digest(packing.pack(docs))


STAGES = [("quality", _quality), ("near_duplicates", _near), ("decontamination", _leaks), ("secrets", _secrets), ("packing", _pack)]

#: The classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written on its way is removed once its result is saved."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = storage.mark()
    for name, stage in STAGES:
        docs = storage.keep(stage(spark, docs, sf_dir), name)
        storage.sweep(spark, mark, but=docs)
    return docs
