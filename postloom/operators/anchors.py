"""Roll-ups of entries: by author, by topic, warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.numbering import dense_number
from postloom.rules import Topic


def author_anchors(entries: DataFrame) -> DataFrame:
    """One row for each author, numbered by first floor. entries: entry_id, author_key, topic_id, chosen_lou, source_lous, confidence, needs_manual_review."""
    rolled = entries.groupBy("author_key").agg(
        F.count("*").alias("entry_count"),
        F.array_sort(F.collect_list("entry_id")).alias("entry_ids"),
        F.array_sort(F.collect_set("topic_id")).alias("topic_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_lous")))).alias("lous"),
        F.round(F.avg("confidence"), 4).alias("confidence"),
        F.bool_or("needs_manual_review").alias("needs_manual_review"),
    )
    rolled = rolled.withColumn("first_lou", F.element_at("lous", 1))
    return dense_number(rolled, "anchor_id", F.lit(0), F.col("first_lou"), ["author_key"])


def topic_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("topic_id").agg(F.count("*").alias("entries"))


def topic_table(spark, topics: tuple[Topic, ...]) -> DataFrame:
    rows = [(n, t.id, t.name, t.short_name, t.allow_multiple_per_author, t.end_time) for n, t in enumerate(topics)]
    return spark.createDataFrame(rows, "ord int, topic_id string, topic_name string, short_name string, allow_multiple boolean, end_time string")


def topic_options(entries: DataFrame, topics: DataFrame) -> DataFrame:
    """Counts of all topics, those without entries and unknown ones included, and `all`."""
    counts = entries.groupBy("topic_id").agg(F.count("*").alias("n"))
    listed = topics.select("topic_id").join(counts, "topic_id", "full").select("topic_id", F.coalesce("n", F.lit(0)).alias("n"))
    return listed.unionByName(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("all").alias("topic_id"), "n"))


def topic_names(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """Adds topic_name; unknown topics are called by their id."""
    names = topics.select("topic_id", "topic_name")
    return rows.join(names, "topic_id", "left").withColumn("topic_name", F.coalesce("topic_name", "topic_id"))


def warning_details(entries: DataFrame, warnings: DataFrame) -> DataFrame:
    """Entries to be looked at and run-time warnings (lou, message) in one table."""
    flagged = entries.where("needs_manual_review").select(F.lit("entry_review").alias("type"), F.col("chosen_lou").alias("lou"), "entry_id", F.coalesce("note", F.lit("需要人工复核")).alias("message"))
    return flagged.unionByName(warnings.select(F.lit("runtime_warning").alias("type"), "lou", "message"), allowMissingColumns=True)
