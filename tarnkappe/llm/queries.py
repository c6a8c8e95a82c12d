"""The queries of the operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tarnkappe.llm import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Vocabulary files stay where they are; TOKENIZER_DIR names another folder."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnkappe.llm.forest import forest_query

    return forest_query(_table(spark, sf_dir, "embeddings"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnkappe.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op3_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnkappe.llm.tokens import token_archive_query

    return token_archive_query(spark, _table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


def op4_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnkappe.llm.chat import chat_query

    return chat_query(spark, _table(spark, sf_dir, "conversations"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnkappe.llm.warc import warc_query

    return warc_query(spark, _table(spark, sf_dir, "pages"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnkappe.llm.mixing import mix_query

    return mix_query(_table(spark, sf_dir, "documents"))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnkappe.llm.syncmers import fingerprint_query

    return fingerprint_query(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnkappe.llm.packing import pack_query

    return pack_query(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnkappe.llm.quality import quality_query

    return quality_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnkappe.llm.lm import lm_query

    return lm_query(_table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnkappe.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnkappe.llm.centroids import cluster_query

    return cluster_query(_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnkappe.llm.fim import fim_query

    return fim_query(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_prefix_forest": op1_prefix_forest,
    "op2_minhash": op2_minhash,
    "op3_token_archive": op3_token_archive,
    "op4_chat_examples": op4_chat_examples,
    "op5_warc_archive": op5_warc_archive,
    "op6_source_mix": op6_source_mix,
    "op7_syncmers": op7_syncmers,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_lm_scores": op10_lm_scores,
    "op11_simhash": op11_simhash,
    "op12_centroids": op12_centroids,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL = {"op2_minhash": oracles.OP2, "op4_chat_examples": oracles.OP4, "op5_warc_archive": oracles.OP5, "op12_centroids": oracles.OP12, "op13_fill_in_middle": oracles.OP13}
