"""From documents to a training mix, in five stages, each over all that the one before kept.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``; the
last adds to doc_id the words that the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, line_dedup, mixing, near_dup, quality, scratch

#: Learned models, hashes and draws are not expressible in SQL; the tests hold stages against plain versions.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the positive-unlabelled classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.learn(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated multi-line chunks out of texts; documents left without a line go."""
    kept = line_dedup.remove_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five words, a similarity of 0.8."""
    return near_dup.keep(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of each document so that sources come to their target weights."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_dup", near_dup_stage),
    ("decontam", decontam_stage),
    ("mix", mix_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what a stage saved is freed once its result stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = scratch.tables()
    for name, stage in STAGES[:-1]:
        docs = scratch.saved(stage(spark, docs, sf_dir), name)
        scratch.clean(keep=others | {docs.scratch_path})
    return STAGES[-1][1](spark, docs, sf_dir)
