"""A training corpus from raw documents: quality rules, near copies, benchmark leaks, personal data, mixing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from harrow.llm import common, decontam, jaccard, mixing, pii, quality
from harrow.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, vocabulary("piece_bpe_32k.model"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, position=True)


STAGES = [("quality_rules", quality_rules), ("near_copies", near_copies), ("decontamination", decontamination), ("personal_data", personal_data), ("mixture", mixture)]

#: No SQL: trained models, vocabularies and similarity decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: the columns of documents and size, source_size, target, taken, position. Each stage but the
    last is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
