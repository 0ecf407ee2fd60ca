"""Corpus pipeline: quality rules, quality classifier, near-dedup, decontamination, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet to the shared checkpoint folder and read again as the next stage's
documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracefuse.llm import bpe, decontam, line_rules, quality_net, simhash
from tracefuse.llm.common import ship_package, table
from tracefuse.llm.queries import tokenizer_path
from tracefuse.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and cross-document line rules keep, without their lines above the limit."""
    ship_package(spark)
    return line_rules.strip_lines(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good with a calibrated probability of a half or more.

    The classifier learns from the labelled documents among those that are left.
    """
    return quality_net.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    ship_package(spark)
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with the digests of ids and decoded text."""
    ship_package(spark)
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokenise", tokenise),
]

#: no SQL: the classifier, the fingerprints, the alignment and the tokenizer are outside SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; returns what the last one wrote."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
