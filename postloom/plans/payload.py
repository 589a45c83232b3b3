"""Results as nested JSON: what a whole run says in one text, and such texts read back as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.markup import post_url
from postloom.functions.typed import as_float, as_int, as_ints, as_text, elements, holds, is_nothing, member, members, plain

#: What entries rebuilt from posts are called.
NO_TOPIC, NO_TOPIC_NAME = "unclassified", "未分类"


def with_sources(entries: DataFrame, posts: DataFrame) -> DataFrame:
    """Adds source_posts: of each of an entry's own floors the first post, by floor. entries: entry_id, author_key, source_lous; posts: ord, lou, pid, author_key, uid, username, postdate, content, attachments."""
    named = entries.select("entry_id", "author_key", F.explode("source_lous").alias("lou"))
    shown = F.struct("lou", "pid", post_url(F.col("pid")).alias("url"), "postdate", F.struct("uid", "username").alias("author"), "content", "attachments")
    first = posts.groupBy("author_key", "lou").agg(F.min_by(F.struct(*[c for c in ("pid", "postdate", "uid", "username", "content", "attachments")]), "ord").alias("p"))
    found = named.join(first.select("author_key", "lou", "p.*"), ["author_key", "lou"]).groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lou", shown.alias("s")))), lambda x: x["s"]).alias("source_posts"))
    return entries.join(found, "entry_id", "left")


def entry_json(entries: DataFrame) -> DataFrame:
    """(entry_id, json): each entry as an object whose fields keep their types. entries: any columns with fields, a map of JSON texts."""
    parts = F.transform(F.map_entries("fields"), lambda e: F.concat(F.to_json(F.parse_json(F.concat(F.lit('"'), F.replace(F.replace(e["key"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))), F.lit(":"), F.coalesce(F.to_json(F.try_parse_json(e["value"])), F.to_json(F.array(e["value"])))))
    rest = F.to_json(F.struct(*[c for c in entries.columns if c != "fields"]), {"ignoreNullFields": "false"})
    return entries.select("entry_id", F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(',"fields":{'), F.array_join(F.coalesce(parts, F.array().cast("array<string>")), ","), F.lit("}}")).alias("json"))


def topics_of(payloads: DataFrame, key: str) -> DataFrame:
    """(key, ord, topic_id, topic_name, short_name): the topics that a result lists, else those of its rule. payloads: key, payload."""
    v = F.try_parse_json("payload")
    listed = F.coalesce(elements(member(v, "topics")), elements(member(member(v, "parsed_rule"), "topics")))
    each = payloads.select(key, F.posexplode(listed).alias("ord", "t")).where(members(F.col("t")).isNotNull())
    of = lambda name: plain(member(F.col("t"), name))
    return each.select(key, "ord", of("id").alias("topic_id"), of("name").alias("topic_name"), of("short_name").alias("short_name"))


def _rebuilt(v: Column) -> Column:
    """Entries of the anchors, in order; an anchor without any gives one for each post."""
    none = F.lit(None).cast("variant")
    nothing = F.array().cast("array<struct<entry:variant,post:variant,anchor:variant>>")

    def of(anchor: Column) -> Column:
        own = F.transform(elements(member(anchor, "entries")), lambda e: F.struct(e.alias("entry"), none.alias("post"), none.alias("anchor")))
        posts = F.transform(elements(member(anchor, "posts")), lambda p: F.struct(none.alias("entry"), p.alias("post"), anchor.alias("anchor")))
        return F.when(F.size(own) > 0, own).otherwise(F.coalesce(posts, nothing))

    given = F.transform(elements(member(v, "entries")), lambda e: F.struct(e.alias("entry"), none.alias("post"), none.alias("anchor")))
    anchors = F.flatten(F.transform(elements(member(v, "anchors")), of))
    return F.when(is_nothing(member(v, "entries")), F.coalesce(anchors, nothing)).otherwise(F.coalesce(given, nothing))


def entries_of(payloads: DataFrame, key: str) -> DataFrame:
    """Entries of results: those that they list, or else rebuilt from their anchors and posts.

    payloads: key, payload (JSON text; one that is none has no entries). One row for each entry:
    key, place (from 0), entry_id, topic_id, topic_name, uid, username, lou, postdate, url,
    content, source_lous, confidence, needs_manual_review, has_duplicate, note, fields (JSON texts).
    A rebuilt entry's id is its place from 1.
    """
    each = payloads.select(key, F.posexplode(_rebuilt(F.try_parse_json("payload"))).alias("place", "x"))
    entry, post, anchor = (F.col(f"x.{c}") for c in ("entry", "post", "anchor"))
    made = post.isNotNull()
    either = lambda name: F.when(made, member(post, name)).otherwise(member(entry, name))
    author = member(F.when(made, anchor).otherwise(entry), "author")
    twice = member(F.when(made, anchor).otherwise(entry), "has_duplicate")
    lou = as_int(either("lou"))
    own_lous = F.when(lou.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(lou))
    return each.select(
        key,
        "place",
        F.when(made, F.col("place").cast("long") + 1).otherwise(as_int(member(entry, "id"))).alias("entry_id"),
        F.when(made, NO_TOPIC).otherwise(plain(member(entry, "topic_id"))).alias("topic_id"),
        F.when(made, NO_TOPIC_NAME).otherwise(plain(member(entry, "topic_name"))).alias("topic_name"),
        plain(member(author, "uid")).alias("uid"),
        plain(member(author, "username")).alias("username"),
        lou.alias("lou"),
        plain(either("postdate")).alias("postdate"),
        F.coalesce(as_text(either("url")), post_url(plain(either("pid")))).alias("url"),
        plain(either("content")).alias("content"),
        F.when(made, own_lous).otherwise(as_ints(member(entry, "source_lous"))).alias("source_lous"),
        as_float(either("confidence")).alias("confidence"),
        holds(either("needs_manual_review")).alias("needs_manual_review"),
        holds(twice).alias("has_duplicate"),
        as_text(either("classification_note")).alias("note"),
        F.coalesce(F.transform_values(members(member(entry, "fields")), lambda _, f: F.to_json(f)), F.create_map().cast("map<string,string>")).alias("fields"),
    )


def read_payloads(spark, path: str) -> DataFrame:
    """(path, payload) of JSON files, each a result of its own."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
