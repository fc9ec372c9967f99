"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphloom.llm.substring_dedup import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents"))


def op2_hmm_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphloom.llm.hmm_lm import hmm_scores

    return hmm_scores(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphloom.llm.line_dedup import line_dedup

    return line_dedup(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphloom.llm.html_extraction import extract

    return extract(_table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphloom.llm.token_counts import by_lines

    return by_lines(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphloom.llm.decontamination import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphloom.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphloom.llm.ngram_jaccard import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphloom.llm.language_id import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from glyphloom.llm import embedding_dedup, line_dedup, ngram_jaccard, substring_dedup

    return {
        "op1_substring_dedup": substring_dedup.ORACLE_SQL,
        "op3_line_dedup": line_dedup.ORACLE_SQL,
        "op7_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op8_ngram_jaccard_join": ngram_jaccard.ORACLE_SQL,
    }
