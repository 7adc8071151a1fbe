"""The corpus pipeline: quality, near-duplicates, benchmark passages, tokens.

Each stage takes all that its predecessor kept, and `run` writes each one's rows to the shared
folder and reads them back, so that a lost executor costs no earlier stage; a stage's folder goes
when the next one's is written, the last one's stays, as the result is read from it.

Null and empty texts are documents: the classifier scores them, near-duplicates of an empty text are one group, of which
one stays, and they have no benchmark passage and no tokens. Rows without an id stay where ids decide. Repeated rows are
near-duplicates of each other: one of a group stays. Texts of any length are taken whole. An empty table
gives none, without labels or benchmark nothing is rejected for them. Columns beside those of documents go along through all
stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fluxgauge.llm import bpe, decontaminate, quality, simhash
from fluxgauge.llm.common import shared_folder, table
from fluxgauge.llm.queries import vocabulary
from fluxgauge.sources.files import Files


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't fill to a twentieth or more."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what stayed."""
    return bpe.digests(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_dedup", keep_first),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The classifier learns, and DuckDB has no XXH64: tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    files, before = Files(spark, folder), None
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            files.drop(before)
        before = path
    return docs
