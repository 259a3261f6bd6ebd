"""The queries of this package: name to function of (spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontamination, jaccard_join, line_dedup, pii_crf, quality_rules, sharding, substring_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_runs(table(spark, sf_dir, "documents")).select("doc_id", "n_removed", "removed", "text")


def op2_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.apply(docs, quality_rules.fit(docs, labels))


def vocabulary() -> byte_bpe.Vocabulary:
    import public_tokenizers

    return byte_bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"), vocabulary())


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.with_hostile(table(spark, sf_dir, "conversations")))


def op5_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_crf.find(docs, pii_crf.fit(docs))


#: Bytes of text a shard holds at most.
SHARD_BYTES = 1 << 20


def op6_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op7_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op8_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.apply(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "sentences")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_runs(table(spark, sf_dir, "documents")).select("doc_id", "n_removed", "removed", "text")


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_substring_dedup,
        op2_quality_forest,
        op3_byte_bpe,
        op4_chat_windows,
        op5_pii_crf,
        op6_extendible_sharding,
        op7_partenum_jaccard,
        op8_toxicity_mil,
        op9_line_dedup,
        op10_template_decontamination,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_windows": chat_format.SQL, "op6_extendible_sharding": sharding.SQL.format(limit=SHARD_BYTES)}
