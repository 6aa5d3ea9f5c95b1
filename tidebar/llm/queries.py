"""Queries of the text problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .leakage import find_leaks
from .mixing import mix, plan_mix, shares
from .reading import grade_documents, profile


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaks per test item: which items are spoilt, and how badly."""
    leaks = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))
    return leaks.groupBy("item_id").agg(F.count("*").alias("docs"), F.max("words").alias("longest"), F.sum(F.col("answer_near").cast("long")).alias("with_answer"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(*plan_mix(table(spark, d, "documents"), table(spark, d, "mix_target")))


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return grade_documents(table(spark, d, "documents"), table(spark, d, "reading_label"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).select("doc_id", "grade")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile(_graded(spark, d))


QUERIES = {f.__name__: f for f in (p7_found, p7_items, p8_mix, p8_shares, p9_found, p9_profile)}
SQL: dict[str, str] = {}
