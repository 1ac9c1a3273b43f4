"""The operators' queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, dac, embeddings, lshforest, matroska, mixing, packing, toxicity, urls, wrappers
from .common import read_table


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(matroska.store(read_table(spark, sf_dir, "documents")))


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file on this machine, as on each executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.classes(read_table(spark, sf_dir, "documents"))


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.classes(read_table(spark, sf_dir, "embeddings"))


def op8_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(read_table(spark, sf_dir, "pages"))


def op9_token_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(read_table(spark, sf_dir, "documents"))


def op7_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_matroska": op1_matroska,
    "op2_sum_of_squares_packing": op2_sum_of_squares_packing,
    "op3_lsh_forest": op3_lsh_forest,
    "op4_weak_supervision": op4_weak_supervision,
    "op5_pfair_mixing": op5_pfair_mixing,
    "op6_pca_tiles": op6_pca_tiles,
    "op7_url_trees": op7_url_trees,
    "op8_wrappers": op8_wrappers,
    "op9_token_dac": op9_token_dac,
    "op10_chat_snapshots": op10_chat_snapshots,
}
ORACLE_SQL: dict[str, str] = {"op3_lsh_forest": lshforest.ORACLE_SQL, "op6_pca_tiles": embeddings.ORACLE_SQL, "op10_chat_snapshots": chat.ORACLE_SQL}
