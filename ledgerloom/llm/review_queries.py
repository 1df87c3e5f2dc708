"""Problem 8 on ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.abuse import THRESHOLD, scored, weights_from
from ledgerloom.session import table


def _scored(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), weights=weights_from(table(spark, sf_dir, "review_examples")), keep=keep)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit content."""
    return _scored(spark, sf_dir).where(F.col("abuse_score") >= THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document and what its heaviest sentence is."""
    return _scored(spark, sf_dir)


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of abusive documents of each source."""
    marks = _scored(spark, sf_dir, "source").select("source", (F.col("abuse_score") >= THRESHOLD).alias("hit"))
    return marks.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("hit").alias("abusive"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("share"))


def queries() -> dict:
    return {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
