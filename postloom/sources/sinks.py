"""Where results go: nested JSON, tables by topic, page dumps, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 4


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One JSON dataset for each table of a result."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def write_failure(spark, message: str, warnings: list[str], folder: str) -> None:
    """The same envelope with what went wrong and no rows."""
    row = spark.createDataFrame([(SCHEMA_VERSION, "failed", message, warnings)], "schema_version int, status string, message string, warnings array<string>")
    row.write.mode("overwrite").json(f"{folder}/meta")


def write_pages(pages: DataFrame, folder: str) -> None:
    pages.drop("_corrupt").write.mode("overwrite").partitionBy("page").json(folder)


def html_buckets(posts: DataFrame, per_part: int = 200) -> DataFrame:
    """(part, html): posts of so many floors joined in order. A part's size is bounded by its floors."""
    part = F.floor(F.col("lou") / per_part).alias("part")
    texts = posts.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("lou", "html"))).alias("x"))
    return texts.select("part", F.array_join(F.col("x.html"), "\n").alias("html"))
