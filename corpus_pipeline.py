"""From raw documents to packed token sequences: reject by quality, drop near-copies, mix sources, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkappe.llm import minhash, mixing, packing, quality
from tarnkappe.llm.queries import tokenizer_file
from tarnkappe.session import small_batches, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of label 1 is at least 0.5; learned from all labels of the documents at hand.

    Null and empty texts are scored as empty ones; repeated rows are judged each; without labels a document's score is
    one half, and all stay; an empty table gives none.
    """
    small_batches(spark)
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held=None)
    return docs.filter(quality.score(net)(F.col("text")) >= 0.5)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: five-word shingles, similarity of 0.8.

    That with the smallest doc_id stays; of several texts of that id the one with the smallest hash, of equal rows one.
    Null texts, texts without words and rows without doc_id are alike with nothing and stay; an empty table gives none.
    """
    return minhash.one_of_each(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often and in the order as the mix takes them; a document may come twice.

    Written, the order is that of the files' numbers and of the rows in a file. A null source is one of its own, and the last;
    null texts and texts without words have size 0 and are not taken; equal rows are taken each, ties in training time go by
    doc_id and text; an empty table gives none.
    """
    return mixing.in_training_order(docs, mixing.mix(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences, with their ids; ``docs`` are read from files and packed in the order of these.

    Null texts are a piece with the end id alone, repeated rows are packed each, an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, length=1024, runs=packing.file_runs(docs))


STAGES = [("quality", quality_stage), ("dedup", dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: A learned classifier and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
