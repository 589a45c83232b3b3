"""Dense numbers without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.tables import keep, shared_folder

PART_BITS = 33  # of Spark's increasing ids: a partition's number stands above, a row's place in it below


def in_order(df: DataFrame, key: Sequence[str], path: str) -> DataFrame:
    """df sorted by key over all partitions, kept as a table, with _part (the partition) and _at (the place in all, with gaps between partitions).

    Ranges are cut at sampled splitters over the whole key; a row's place of origin comes last
    in it, so rows that are equal in everything else are dealt to several tasks, too. Nulls come first.
    """
    ranged = df.withColumn("_origin", F.monotonically_increasing_id()).repartitionByRange(*key, "_origin")
    placed = ranged.sortWithinPartitions(*key, "_origin").drop("_origin").withColumn("_at", F.monotonically_increasing_id())
    # where a range begins hangs on the sample, so it has to be written down once
    return keep(placed.withColumn("_part", F.shiftright("_at", PART_BITS).cast("int")), path)


def dense_number(df: DataFrame, name: str, major: Column, minor: Column, ties: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """1, 2, ... by (major, minor, ties), in each group of `within` or over all rows.

    major and minor are integers, ties any columns that can be ordered. Rows are sorted by ranges
    (see in_order); how many rows of a group stand in the partitions before is added. Nulls come
    first; rows that are equal in all of the key get numbers in no particular order.
    """
    folder = shared_folder(df.sparkSession)
    own = df.columns
    placed = in_order(df.withColumns({"_major": major.cast("long"), "_minor": minor.cast("long")}), [*within, "_major", "_minor", *ties], f"{folder}/ordered")
    parts = placed.groupBy(*within, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # without groups as many rows as there are partitions; with them, a group has a row for each partition that it reaches into
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keep(parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), f"{folder}/parts")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*within, "_part")]
    joined = placed.alias("r").join(parts.alias("s") if within else F.broadcast(parts.alias("s")), same)
    return joined.select(*[F.col(f"r.`{c}`") for c in own], (F.col("r._at") - F.col("s._first") + F.col("s._before") + 1).alias(name))


def entry_ids(entries: DataFrame, topic_order: dict[str, int]) -> DataFrame:
    """entry_id by topic order (unknown topics last), floor, author."""
    order = F.lit(999)
    for topic, n in topic_order.items():
        order = F.when(F.col("topic_id") == topic, n).otherwise(order)
    return dense_number(entries, "entry_id", order, F.col("chosen_lou"), ["author_key", "ord"])


def author_numbers(rows: DataFrame) -> DataFrame:
    """author_number by first appearance, and maybe_duplicate where an author has several rows."""
    authors = rows.groupBy("author_key").agg(F.min("lou").alias("_first"), F.count("*").alias("_n"))
    authors = dense_number(authors, "author_number", F.lit(0), F.col("_first"), ["author_key"])
    return rows.join(authors.select("author_key", "author_number", (F.col("_n") > 1).alias("maybe_duplicate")), "author_key")


def unique_titles(titles: DataFrame, limit: int = 31) -> DataFrame:
    """Sheet titles cut to the limit, with _2, _3 for repeated ones (title, ord)."""
    n = F.row_number().over(Window.partitionBy(F.lower(F.substring("title", 1, limit))).orderBy("ord"))
    suffix = F.concat(F.lit("_"), n.cast("string"))
    return titles.withColumn("sheet", F.when(n == 1, F.substring("title", 1, limit)).otherwise(F.concat(F.substr("title", F.lit(1), limit - F.length(suffix)), suffix)))
