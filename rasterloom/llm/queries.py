"""One query for each operator, over its whole table and with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import curriculum, exact_topk, jaccard_join, line_dedup, quality_fm, quality_rules, token_blocks, token_count, trie_bpe, warc


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_blocks(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.digests(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(_table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.digest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_blocks, op2_warc_bundles, op3_quality_rules, op4_token_counts, op5_line_dedup, op6_quality_classifier, op7_trie_bpe, op8_jaccard_join, op9_exact_topk, op10_curriculum_mix]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_bundles": warc.ORACLE,
        "op3_quality_rules": quality_rules.oracle_sql(),
        "op5_line_dedup": line_dedup.ORACLE,
        "op8_jaccard_join": jaccard_join.ORACLE,
        "op9_exact_topk": exact_topk.ORACLE,
        "op10_curriculum_mix": curriculum.ORACLE,
    }
