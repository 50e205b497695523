"""The queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm import bwt_repeats, edit_lines, forced_bpe, hashmix, hyperminhash, language_mixture, nbsvm, personal_data, piece_agenda, progressive_jpeg, quality_rules, segment_codes, source_divergence
from tamiz.llm.session import ensure_checkpoint_dir


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.language_mixture(_documents(spark, sf_dir))


def op2_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_quality(_documents(spark, sf_dir))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(_documents(spark, sf_dir))


def op4_edit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_lines.dedup_lines(_documents(spark, sf_dir)).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(_documents(spark, sf_dir))


def op6_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forced_bpe.bpe_round_trip(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op7_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_repeats.remove_repeats(_documents(spark, sf_dir), digest=True)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashmix.hash_threshold_mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.media_columns(_documents(spark, sf_dir))


def op10_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_segment_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_agenda.piece_round_trip(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op11_segment_codes": segment_codes.ORACLE_SQL, "op8_source_mix": hashmix.ORACLE_SQL, "op13_source_divergence": source_divergence.ORACLE_SQL}
