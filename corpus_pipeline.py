"""A corpus cleaning pipeline: five stages over the documents table, each written as Parquet and read again.

The stages but the last return the columns of ``documents``; the last returns each document's tokens and their digests.
An empty table passes through; nulls are treated as each operator's module states. Documents
that the line stage leaves without any word have nothing left to keep, and go there. Rows are known by doc_id and text, so rows
that repeat an id with another text are judged by themselves; columns of any name pass through.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tamiz.llm import edit_lines, forced_bpe, hashmix, hyperminhash, nbsvm
from tamiz.llm.session import ensure_checkpoint_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ensure_checkpoint_dir(spark)
    return nbsvm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, but for the first of each class."""
    ensure_checkpoint_dir(spark)
    return edit_lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    ensure_checkpoint_dir(spark)
    return hyperminhash.without_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it."""
    ensure_checkpoint_dir(spark)
    return hashmix.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, the digests of ids and decoded text."""
    return forced_bpe.bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("encode", encode)]

#: The hash signatures, the edit join and the classifier have no SQL form; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what lies between them is written to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
