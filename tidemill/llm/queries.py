"""The registered query of each corpus operator, with production parameters, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_sentencepiece, op2_dartminhash, op3_chat, op4_ego, op5_langid, op6_pii, op7_sharding, op8_packing, op9_quality, op10_toxicity
from .common import table


def tokenizer_path(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file; every machine has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_sentencepiece.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_dartminhash.classes(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold the control strings of another template."""
    whole = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return op3_chat.digest(whole.unionByName(planted))


def op4_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_ego.links(table(spark, sf_dir, "embeddings"))


def op5_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_langid.digest(table(spark, sf_dir, "documents"))


def op6_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_pii.digest(table(spark, sf_dir, "documents"))


def op7_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_sharding.shards(table(spark, sf_dir, "documents"))


def op8_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality.digest(table(spark, sf_dir, "documents"))


def op10_deobfuscated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_viterbi": op1_piece_viterbi,
    "op2_dart_minhash": op2_dart_minhash,
    "op3_chat_format": op3_chat_format,
    "op4_ego_join": op4_ego_join,
    "op5_crf_language": op5_crf_language,
    "op6_sanitise": op6_sanitise,
    "op7_hash_tree": op7_hash_tree,
    "op8_cutting_stock": op8_cutting_stock,
    "op9_rule_ledger": op9_rule_ledger,
    "op10_deobfuscated": op10_deobfuscated,
}

ORACLE: dict[str, str] = {
    "op3_chat_format": op3_chat.ORACLE,
    "op9_rule_ledger": op9_quality.ORACLE,
}
