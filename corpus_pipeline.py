"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import curriculum, jaccard_join, line_dedup, quality_fm, trie_bpe
from rasterloom.llm.common import discard, materialize
from rasterloom.llm.queries import tokenizer

#: Scores under this are rejected.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows outside the held-out fold, doesn't reject."""
    model = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality_fm.score_column(docs, model) >= QUALITY)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are equal or similar to an earlier one. A document all of whose lines went is a copy and goes; one that
    had no words before stays."""
    return line_dedup.dedup(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; rows that share a doc_id stay together."""
    stay = jaccard_join.components(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("_stay")), "left_semi")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents as often as their source's target takes them, by training position."""
    return curriculum.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each document of the stream."""
    return trie_bpe.encode(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]

#: The stages train, cluster and encode, which SQL can't express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of each document of the stream. Null texts, repeated rows and null doc_ids are what each stage's operator makes of them; an empty table gives no rows."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # the table of the stage before; the input is left alone
        before = docs
    return docs
