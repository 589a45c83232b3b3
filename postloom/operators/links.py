"""Equi-, anti- and outer joins between posts, submissions and refused rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def item_sources(items: DataFrame, posts: DataFrame) -> DataFrame:
    """Items (author_key, item_no, source_lous, chosen_lou) with the floors that are the author's own.

    Items without any fall back on the author's last floor and are to be looked at;
    chosen_lou defaults to the last source.
    """
    own = posts.select("author_key", "lou")
    named = items.select("author_key", "item_no", F.explode(F.array_distinct("source_lous")).alias("lou")).join(own, ["author_key", "lou"])
    named = named.groupBy("author_key", "item_no").agg(F.array_sort(F.collect_set("lou")).alias("_found"))
    last = own.groupBy("author_key").agg(F.max("lou").alias("_last"))
    out = items.join(named, ["author_key", "item_no"], "left").join(last, "author_key")
    lous = F.coalesce("_found", F.array("_last"))
    chosen = F.when(F.array_contains(lous, F.col("chosen_lou")), F.col("chosen_lou"))
    return out.withColumns({"source_lous": lous, "chosen_lou": F.coalesce(chosen, F.array_max(lous)), "sources_missing": F.col("_found").isNull()}).drop("_found", "_last")


def uncovered(packs: DataFrame, used: DataFrame, ignored: DataFrame) -> DataFrame:
    """Floors (author_key, lou) that neither an item nor a refusal names."""
    return packs.join(used.select("lou"), "lou", "left_anti").join(ignored.select("lou"), "lou", "left_anti")


def new_pairs(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose (lou, topic_id) is not there yet, first in order of `ord` for each."""
    fresh = rows.join(existing.select("lou", "topic_id"), ["lou", "topic_id"], "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy("lou", "topic_id").orderBy("ord"))).where("_n = 1").drop("_n")


def proxies_recovered(ignored: DataFrame, posts: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    """Refused rows that a post on someone's behalf superseded: (recovered, still ignored). posts: lou, content; reason: Column -> Column."""
    held = posts.select(F.col("lou").alias("superseded_by_lou"), reason(F.col("content")).alias("proxy_reason"))
    both = ignored.join(held, "superseded_by_lou", "left")
    return both.where("proxy_reason is not null"), both.where("proxy_reason is null").drop("proxy_reason")


def canonical_files(images: DataFrame) -> DataFrame:
    """(filename, canonical): the first name of each content hash. images: filename, content."""
    hashed = images.select("filename", F.sha2("content", 256).alias("hash"))
    return hashed.join(hashed.groupBy("hash").agg(F.min("filename").alias("canonical")), "hash")


def pending(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    return manifest.join(existing.select("path"), "path", "left_anti")


def download_manifest(urls: DataFrame) -> DataFrame:
    """Distinct urls with their path; collision where different urls share one. urls: url, path."""
    return urls.dropDuplicates(["url"]).withColumn("collision", F.count("*").over(Window.partitionBy("path")) > 1)


def floor_review(entries: DataFrame, ignored: DataFrame) -> DataFrame:
    """One row for each floor named by an entry's sources or a refusal, with distinct hits of both kinds.

    entries: topic_id, chosen_lou, author, source_lous; ignored: lou, author, reason. An
    author named by an entry goes before one named by a refusal.
    """
    hits = entries.select(F.explode("source_lous").alias("lou"), F.lit(0).alias("kind"), "author", F.concat_ws("#", "topic_id", "chosen_lou").alias("hit"))
    hits = hits.unionByName(ignored.select("lou", F.lit(1).alias("kind"), "author", F.col("reason").alias("hit")))
    named = F.min(F.when(F.coalesce(F.col("author"), F.lit("")) != "", F.struct("kind", "author")))["author"]
    some = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("hit")))), "|")
    return hits.groupBy("lou").agg(named.alias("author"), some(0).alias("topic_hits"), some(1).alias("ignore_hits"))
