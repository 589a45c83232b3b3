"""Posts by author, with what they reply to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What a pack shows of the post that a reply quotes.
SHOWN_OF_REPLY = ("has_reply_quote", "reply_quote_count", "reply_to_author", "reply_to_pid", "quoted_preview")


def author_key() -> Column:
    return F.coalesce(
        F.concat(F.lit("uid:"), F.col("uid").cast("string")),
        F.concat(F.lit("name:"), F.nullif(F.col("username"), F.lit(""))),
        F.concat(F.lit("unknown:"), F.coalesce(F.col("lou").cast("string"), F.lit("none"))),
    )


def reply_context_posts(candidates: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts that an author's candidates reply to, without those that are the author's own candidates: author_key, lou, content, linked_from_lous.

    candidates: author_key, lou, pid, reply_to_pid; posts: pid, lou, content (last of equal pids holds).
    """
    # only posts that are asked for are compared
    last = posts.join(candidates.where("reply_to_pid is not null").select(F.col("reply_to_pid").alias("pid")).distinct(), "pid", "left_semi").groupBy("pid").agg(F.max_by(F.struct("lou", "content"), "ord").alias("p")).select("pid", "p.*")
    asked = candidates.where("reply_to_pid is not null").select("author_key", F.col("lou").alias("from_lou"), F.col("reply_to_pid").alias("pid"))
    own = candidates.select("author_key", "pid")
    linked = asked.join(last, "pid").join(own, ["author_key", "pid"], "left_anti")
    return linked.groupBy("author_key", "pid").agg(F.first("lou").alias("lou"), F.first("content").alias("content"), F.array_sort(F.collect_set("from_lou")).alias("linked_from_lous"))


def author_packs(candidates: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """One row for each author: posts by floor, context posts by floor, first_lou. Where candidates have postdate and reply (see reply_context), posts show them."""
    shown = [c for c in ("lou", "pid", "postdate", "content") if c in candidates.columns]
    reply = [F.struct(*[F.col(f"reply.{c}") for c in SHOWN_OF_REPLY]).alias("reply_context")] if "reply" in candidates.columns else []
    packs = candidates.groupBy("author_key").agg(F.array_sort(F.collect_list(F.struct(*shown, *reply))).alias("posts"), F.min("lou").alias("first_lou"))
    if context is None:
        return packs.withColumn("context_posts", F.array().cast("array<struct<lou:bigint,content:string,linked_from_lous:array<bigint>>>"))
    extra = context.groupBy("author_key").agg(F.array_sort(F.collect_list(F.struct("lou", "content", "linked_from_lous"))).alias("context_posts"))
    return packs.join(extra, "author_key", "left")
