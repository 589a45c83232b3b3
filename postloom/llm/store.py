"""Kept tables, and what goes with them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.tables import keep, shared_folder

__all__ = ["drop", "keep", "lean_shuffles", "partitions", "set_aside", "shared_folder"]

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def lean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it Spark deletes an execution's shuffle files as it ends; for work in many steps, each kept as a table."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a kept table that nothing will read again."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def set_aside(docs: DataFrame, needed: tuple[str, ...], made: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """docs with all columns that are not needed renamed, so that none clashes with what an operator adds meanwhile, and the columns that give them back; those with the names it makes are left out."""
    names = {c: f"own{n}" for n, c in enumerate(docs.columns) if c not in needed and c not in made}
    inside = docs.select(*needed, *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return inside, [F.col(names.get(c, c)).alias(c) for c in docs.columns if c not in made]
