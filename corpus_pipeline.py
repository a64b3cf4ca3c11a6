"""Corpus pipeline: documents to packed training sequences, in five stages that each apply one operator to all they get.

Defined results: a null or empty text, or one without a letter, is rejected by the language stage; very long texts are read whole.
Repeated rows and copies leave one row, the one with the least id, null ids last, then the least hash of the text; ties end there.
Null values in other columns and extra columns, whatever their names, pass through all stages but the last. Empty
tables give empty results, and without labelled languages every text with a letter stays.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, langid, packing, secret_scan, simhash
from tessera.llm.common import table, with_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Rows of an Arrow batch: whole texts lie in one several times over, in the JVM and in the worker, so Spark's 10,000 are too many.
BATCH_ROWS = 1000


def in_small_batches(stage: Stage) -> Stage:
    """The stage, run after the session is told to hand at most ``BATCH_ROWS`` rows to a worker at once."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay."""
    return langid.in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item stay."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are masked."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", in_small_batches(language_id)),
    ("near_dedup", in_small_batches(near_dedup)),
    ("decontamination", in_small_batches(decontamination)),
    ("secrets", in_small_batches(secrets)),
    ("packing", in_small_batches(pack)),
]

#: Automata, fingerprints and forests are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each other stage is written to the shared checkpoint folder and read again."""
    with_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
