"""Posts as they come: an addition to the batch tally, for threads that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.sources.pages import PAGE, posts_of


def post_stream(spark: SparkSession, folder: str, late: str = "7 days") -> DataFrame:
    """Posts of newly written page files, each pid once within the watermark."""
    pages = spark.readStream.schema(PAGE).options(multiLine=True, columnNameOfCorruptRecord="_corrupt").json(folder)
    pages = pages.withColumn("page", F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).try_cast("int"))
    posts = posts_of(pages).withColumn("seen_at", F.to_timestamp("postdate", "yyyy-MM-dd HH:mm"))
    return posts.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["pid"])


def hourly_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy(F.window("seen_at", "1 hour")).agg(F.count("*").alias("posts"))
