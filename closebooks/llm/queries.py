"""The registered queries opN_<name> and their SQL, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closebooks.llm import (
    bpe,
    hard_negatives,
    html_text,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    quality,
    sharding,
    suffix_dedup,
    topk,
    toxicity,
    whitening,
)
from closebooks.llm.common import table

SHARDS = 8
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = sharding.tree([1.0] * SHARDS)
    return sharding.sharded(
        table(spark, sf_dir, "documents"), root, sharding.grown(root, 1.0, SHARDS))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.linked(table(spark, sf_dir, "documents"), 4)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passage_digest(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digest(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Labels that disagree with the vectors are part of the task.
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives.mined(rows.withColumn("label", F.coalesce(shifted, F.col("label"))))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_line_dedup, op2_sharding, op3_near_dedup, op4_html_text, op5_mixing,
        op6_suffix_dedup, op7_quality_rules, op8_toxicity, op9_bpe, op10_top_k,
        op11_hard_negatives, op12_packing, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": quality.VERDICTS_SQL, "op10_top_k": topk.TOP_K_SQL,
            "op11_hard_negatives": hard_negatives.MINED_SQL}
