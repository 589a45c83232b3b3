"""Floors that are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = 1 << 20


def missing_ranges(floors: DataFrame, start: int | None = None, end: int | None = None, cell: int = CELL) -> DataFrame:
    """(start, end, count) of runs of missing integers. floors: lou.

    Gaps are read off neighbours instead of listing every expected floor: floors are dealt
    into cells, neighbours compared inside each, and the cells' first and last ones among
    each other, so no task sorts all floors. start and end default to the least and greatest.
    """
    lou = floors.where("lou is not null").select(F.col("lou").cast("long").alias("lou")).distinct()
    if start is not None:
        lou = lou.where(F.col("lou") >= start).union(floors.sparkSession.range(1).select(F.lit(start - 1).cast("long")))
    if end is not None:
        lou = lou.where(F.col("lou") <= end).union(floors.sparkSession.range(1).select(F.lit(end + 1).cast("long")))
    celled = lou.withColumn("cell", F.floor(F.col("lou") / cell))
    inside = celled.withColumn("last", F.lag("lou").over(Window.partitionBy("cell").orderBy("lou"))).where("last is not null").select("last", "lou")
    edges = celled.groupBy("cell").agg(F.min("lou").alias("lo"), F.max("lou").alias("hi"))
    # one task, with a row for each cell that has floors: a millionth of the floors' span
    between = edges.select(F.lag("hi").over(Window.orderBy("cell")).alias("last"), F.col("lo").alias("lou")).where("last is not null")
    gaps = inside.union(between).where("lou - last > 1")
    return gaps.select((F.col("last") + 1).alias("start"), (F.col("lou") - 1).alias("end"), (F.col("lou") - F.col("last") - 1).alias("count"))


def raw_stats(posts: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row: posts, least and greatest floor, missing floors."""
    missing = missing_ranges(posts, start, end).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("missing_count"), F.count("*").alias("range_count"))
    return posts.agg(F.count("*").alias("post_count"), F.min("lou").alias("min_lou"), F.max("lou").alias("max_lou")).join(missing)
