"""A corpus pipeline over ``documents``: filter, de-duplicate, decontaminate, redact, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelab.llm import decontam, mixing, pii, simhash, toxicity
from stridelab.llm.common import ensure_checkpoint_dir, id_bucket, read
from stridelab.llm.queries import MIX_TARGET
from stridelab.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the labels are learned from as in op10."""
    ship_package(spark)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), id_bucket("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: SimHash links as in op8, and five-word Jaccard similarity of 0.8 or more."""
    ship_package(spark)
    return simhash.keep_one_per_group(docs, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go."""
    ship_package(spark)
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    ship_package(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed sequence: every document at least once, those of rare sources again."""
    return mixing.mix(docs, MIX_TARGET)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: Trained scores, edit distances and spans have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between is written below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
