"""Queries p5-p8 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finstrata.llm import leakage, matching, tokenizer, truncation
from finstrata.session import table


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(table(spark, sf_dir, "gleif_candidates"), table(spark, sf_dir, "gleif_review_rows"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_matches(spark, sf_dir).select("lei", "entity_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.sources(table(spark, sf_dir, "documents"))


QUERIES = {
    "p5_found": p5_found, "p5_matches": p5_matches, "p6_ids": p6_ids, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_sources": p8_sources,
}
