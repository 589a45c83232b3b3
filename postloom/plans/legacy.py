"""The older tally: first reason for a refusal, rows by author, possible duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.markup import clean_legacy
from postloom.operators.filters import first_reason
from postloom.operators.numbering import author_numbers
from postloom.rules import Rule


def legacy_tally(posts: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(submissions, refused). Posts without the keyword are in neither."""
    judged = posts.withColumn("ignore_reason", first_reason(rule))
    rows = judged.where("ignore_reason is null").drop("ignore_reason")
    if rule.keyword is not None:
        rows = rows.where(F.contains("content", F.lit(rule.keyword)))
    rows = author_numbers(rows.withColumn("text", clean_legacy(F.col("content"))))
    return rows, judged.where("ignore_reason is not null")


def reconciliation(posts: DataFrame, rows: DataFrame, refused: DataFrame) -> DataFrame:
    """One row: posts, authors, refused, and whether they add up as the older tally expects."""
    n = posts.agg(F.count("*").alias("posts"))
    n = n.join(rows.agg(F.count_distinct("author_key").alias("authors"))).join(refused.agg(F.count("*").alias("refused")))
    return n.withColumn("adds_up", F.col("authors") + F.col("refused") == F.col("posts"))
