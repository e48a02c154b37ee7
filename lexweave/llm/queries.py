"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, jaccard, langid, licenses, lm, oracle, ratio, sharding, winnow
from .storage import id_remainder, prepare, table


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return sharding.shard(docs, "doc_id", "text", n_shards=24)


def tokenizer_spec(name: str = "byte_bpe_50k.json") -> str:
    """Text of a public tokenizer file, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op7_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return bpe.round_trip(docs, "doc_id", "text", tokenizer_spec())


def op1_adaptive_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return jaccard.near_duplicates(docs, "doc_id", "text", k=3, percent=90)


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    return ratio.resample(docs, "doc_id", "text", ratio.trusted_labels(labels))[1]


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return licenses.summary(licenses.scan(docs, "doc_id", "text"), "doc_id")


def op4_attention_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(prepare(spark), sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 7) == 2
    scored = lm.score(docs, "doc_id", "text", ~held_out, tokenizer_spec("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return scored.withColumn("held_out", ~F.col("learned")).drop("learned")


def op5_ratio_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    return ratio.quality_rules(docs, "doc_id", "text", ratio.trusted_labels(labels))


def op8_text_to_tag_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(prepare(spark), sf_dir, "pages"), "page_id", "url", "html")


def op9_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return winnow.decontaminate(docs, "doc_id", "text", items, "item_id", "text")


def op10_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    model = langid.learn(docs, "text", "lang", id_remainder(F.col("doc_id"), 5) != 0)
    found = langid.identify(docs, "doc_id", "text", model)
    return found.withColumn("held_out", id_remainder(F.col("doc_id"), 5) == 0).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def scoring_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op4 that SQL can express."""
    found = op4_attention_scoring(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op5 that SQL can express."""
    return op5_ratio_quality_rules(spark, sf_dir).select("doc_id", *ratio.RULES, "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op6_jump_sharding": op6_jump_sharding,
    "op1_adaptive_prefix_jaccard": op1_adaptive_prefix_jaccard,
    "op2_importance_resampling": op2_importance_resampling,
    "op3_license_scan": op3_license_scan,
    "op4_attention_scoring": op4_attention_scoring,
    "op5_ratio_quality_rules": op5_ratio_quality_rules,
    "op8_text_to_tag_extraction": op8_text_to_tag_extraction,
    "op9_winnowing_decontamination": op9_winnowing_decontamination,
    "op10_compression_langid": op10_compression_langid,
    "op7_backtracking_bpe": op7_backtracking_bpe,
    "scoring_base_columns": scoring_base_columns,
    "quality_base_columns": quality_base_columns,
}

#: The others have no SQL equivalent (trained models, parsers, compressors) and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_adaptive_prefix_jaccard": oracle.OP1,
    "op3_license_scan": oracle.OP3,
    "op6_jump_sharding": oracle.OP6,
    "op9_winnowing_decontamination": oracle.OP9,
    "scoring_base_columns": oracle.BASE4,
    "quality_base_columns": oracle.BASE5,
}
