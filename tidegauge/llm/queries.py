"""Queries of the text problems 8 to 10, with their production parameters, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import leaks, reading, tokenize
from tidegauge.queries import Registry, table

registry = Registry()


@registry.add("p8_ids")
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, folder, "documents"))


@registry.add("p8_text", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p8_text(spark: SparkSession, folder: str) -> DataFrame:
    """Round trip: what the ids of each document decode to."""
    return tokenize.decode_corpus(tokenize.encode_corpus(table(spark, folder, "documents")))


@registry.add("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "labels"))


@registry.add("p10_found")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).where(f"level >= {reading.DEMANDING}").select("doc_id")


@registry.add("p10_levels")
def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder)
