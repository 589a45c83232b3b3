"""What readers of a result see: search, running numbers, text export, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.markup import export_reason, floor_label
from postloom.functions.order import natural_key
from postloom.functions.scalars import cell, flag_label, percent_label
from postloom.functions.typed import field_cell
from postloom.operators.filters import matches
from postloom.operators.numbering import dense_number

#: Fields of the default topics in the order of their sheets, and the columns before and after them.
FIELD_ORDER = {
    "theme1_travel": ["人物", "地点", "事件"],
    "theme2_training": ["老师", "主要属性培养", "事件"],
    "theme2_guest": ["客人", "事件"],
    "theme3_engagement": ["人物", "地点", "事件"],
    "theme4_carriage_name": ["名字"],
    "qa": ["问题"],
}
HEADINGS_BEFORE = ("序号", "投稿楼层", "发布时间", "作者", "UID")
HEADINGS_AFTER = ("统计结果", "来源楼层", "加权目标", "加权目标楼层", "加权目标作者", "需要复核", "备注", "链接")


def searched(rows: DataFrame, term: str, topic: str = "all") -> DataFrame:
    out = rows.where(matches(F.col("search"), term))
    return out if topic == "all" else out.where(F.col("topic_id") == topic)


def visible_refusals(ignored: DataFrame) -> DataFrame:
    """Refusals without those that only say that a post stands before the first floor."""
    return ignored.where(~F.coalesce(F.col("ignore_reason").contains("小于等于起始楼层"), F.lit(False)))


def duplicates(entries: DataFrame) -> DataFrame:
    return entries.where("has_duplicate")


def to_review(entries: DataFrame) -> DataFrame:
    """Entries that somebody has to look at, or that have duplicates."""
    return entries.where("coalesce(needs_manual_review, false) or coalesce(has_duplicate, false)")


def topics_in_order(topics: DataFrame, entries: DataFrame, by_first: bool = False) -> DataFrame:
    """(topic_id, topic_name, place): listed topics in their order, then those that only entries name: by id, or by their first entry."""
    listed = topics.groupBy("topic_id").agg(F.min("ord").cast("long").alias("at"), F.min_by("topic_name", "ord").alias("topic_name")).where("topic_id <> ''")
    other = entries.groupBy(F.coalesce(F.nullif(F.col("topic_id"), F.lit("")), F.lit("unclassified")).alias("topic_id")).agg(F.min("entry_id").alias("first"))
    other = other.join(listed.select("topic_id"), "topic_id", "left_anti").select("topic_id", "first", F.col("topic_id").alias("topic_name"))
    rows = listed.select("topic_id", "topic_name", F.lit(0).alias("kind"), "at").unionByName(other.select("topic_id", "topic_name", F.lit(1).alias("kind"), (F.col("first") if by_first else F.lit(0)).cast("long").alias("at")))
    return dense_number(rows, "place", F.col("kind"), F.col("at"), ["topic_id"]).select("topic_id", "topic_name", "place")


def review_hits(entries: DataFrame, ignored: DataFrame) -> DataFrame:
    """(lou, topic_hits, ignore_hits): what names each floor; hits by floor and label, refusals by reason, both in natural order, each once.

    entries: source_lous, chosen_lou, topic_name; ignored: lou, ignore_reason.
    """
    hits = entries.select(F.explode("source_lous").alias("lou"), F.struct(F.col("chosen_lou").cast("long").alias("chosen_lou"), F.col("topic_name").alias("label")).alias("hit")).distinct()
    topics = hits.groupBy("lou").agg(F.transform(F.array_sort(F.collect_list(F.struct("hit.chosen_lou", natural_key(F.col("hit.label")).alias("key"), "hit"))), lambda x: x["hit"]).alias("topic_hits"))
    reasons = ignored.where("lou is not null").select("lou", F.col("ignore_reason").alias("reason")).distinct()
    reasons = reasons.groupBy("lou").agg(F.transform(F.array_sort(F.collect_list(F.struct(natural_key(F.col("reason")).alias("key"), "reason"))), lambda x: x["reason"]).alias("ignore_hits"))
    return topics.join(reasons, "lou", "full")


def topic_numbers(entries: DataFrame) -> DataFrame:
    return dense_number(entries, "topic_number", F.lit(0), F.col("entry_id"), [], within=["topic_id"])


def text_export(entries: DataFrame, ignored: DataFrame, lines: int = 1000, tab: str = "entries", topic: str = "all") -> DataFrame:
    """(topic_id, part, body): entries of a topic as marked-up lines, and refusals that have a reason left, in parts of so many lines.

    Refusals go out with all topics' entries only; the tab `duplicates` shows entries that have any.
    """
    if tab == "duplicates":
        entries = duplicates(entries)
    if topic != "all":
        entries = entries.where(F.col("topic_id") == topic)
    if tab != "entries" or topic != "all":
        ignored = ignored.where("false")
    ignored = visible_refusals(ignored)
    line = F.concat(F.lit("[b]"), floor_label(F.col("source_lous"), F.col("chosen_lou")), F.lit("[/b] "), F.coalesce("text", F.lit("")))
    rows = entries.select("topic_id", F.col("entry_id").alias("n"), line.alias("line"))
    reason = export_reason(F.col("ignore_reason"))
    lost = ignored.select(F.lit("ignored").alias("topic_id"), F.col("lou").alias("n"), F.concat(F.lit("[s]#"), F.col("lou").cast("string"), F.lit("[/s] "), reason).alias("line"), reason.alias("r")).where("r <> ''").drop("r")
    placed = dense_number(rows.unionByName(lost), "at", F.lit(0), F.col("n"), [], within=["topic_id"])
    grouped = placed.groupBy("topic_id", F.floor((F.col("at") - 1) / lines).alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    return grouped.select("topic_id", "part", F.array_join("x.line", "\n").alias("body"))


def field_headers(entries: DataFrame, first: dict[str, list[str]] | None = None, of: DataFrame | None = None) -> DataFrame:
    """(topic_id, headers): names of a topic's fields: the fixed ones of FIELD_ORDER, then by the entry that names them first, those of one entry in order of their letters.

    A list is as long as a sheet is wide. Topics are those of the entries, and those of `of`.
    """
    order = first if first is not None else FIELD_ORDER
    fixed = entries.sparkSession.createDataFrame([(t, -1, n, f) for t, fields in order.items() for n, f in enumerate(fields)] or [("", -1, 0, "")], "topic_id string, lou long, at int, field string")
    topics = entries.select("topic_id") if of is None else entries.select("topic_id").union(of.select("topic_id"))
    topics = topics.where("topic_id is not null").distinct()
    fixed = fixed.join(topics, "topic_id", "left_semi")
    own = entries.select("topic_id", F.coalesce("chosen_lou", "entry_id").alias("lou"), F.posexplode(F.map_keys("fields")).alias("at", "field"))
    firsts = fixed.unionByName(own).groupBy("topic_id", "field").agg(F.min(F.struct("lou", "at", "field")).alias("x"))
    sorted_ = firsts.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["field"]).alias("headers"))
    return topics.join(sorted_, "topic_id", "left").withColumn("headers", F.coalesce("headers", F.array().cast("array<string>")))


def sheet_cells(entries: DataFrame, headers: DataFrame) -> DataFrame:
    """(topic_id, row_no, cells): row 0 has the headings, then one row for each entry by floor; as many cells as headings.

    entries: topic_id, entry_id, chosen_lou, source_lous, fields (JSON texts) and, as text, postdate,
    username, uid, content, target, target_lou, target_author, notes, url; needs_manual_review.
    """
    numbered = dense_number(entries, "row_no", F.col("chosen_lou").isNull().cast("int"), F.coalesce("chosen_lou", "entry_id"), ["entry_id"], within=["topic_id"])
    rows = numbered.join(headers, "topic_id", "left").withColumn("headers", F.coalesce("headers", F.array().cast("array<string>")))
    text = lambda c: cell(F.col(c))
    own = F.transform("headers", lambda h: F.coalesce(field_cell(F.try_element_at("fields", h)), F.lit("")))
    before = F.array(*map(text, ("row_no", "chosen_lou", "postdate", "username", "uid")))
    after = F.array(text("content"), floor_label(F.col("source_lous"), F.col("chosen_lou")), *map(text, ("target", "target_lou", "target_author")), F.coalesce(flag_label(F.col("needs_manual_review")), F.lit("")), text("notes"), text("url"))
    body = rows.select("topic_id", "row_no", F.concat(before, own, after).alias("cells"))
    top = headers.select("topic_id", F.lit(0).cast("long").alias("row_no"), F.concat(F.array(*map(F.lit, HEADINGS_BEFORE)), "headers", F.array(*map(F.lit, HEADINGS_AFTER))).alias("cells"))
    return body.unionByName(top)


def sheet_widths(cells: DataFrame, cap: int = 60, looked_at: int = 200) -> DataFrame:
    """(topic_id, column, width) of sheet_cells: the longest of the first rows and two more, at least 10 and at most the cap."""
    each = cells.where(F.col("row_no") < looked_at).select("topic_id", F.posexplode("cells").alias("column", "cell"))
    return each.groupBy("topic_id", "column").agg(F.least(F.lit(cap), F.greatest(F.lit(10), F.max(F.length("cell")) + 2)).alias("width"))


def sheet_rows(entries: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each entry with a column for each field, numbered by floor in its topic."""
    numbered = dense_number(entries, "row_no", F.col("chosen_lou").isNull().cast("int"), F.coalesce("chosen_lou", "entry_id"), ["entry_id"], within=["topic_id"])
    return numbered.select("topic_id", "row_no", "entry_id", "chosen_lou", *[field_cell(F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit(""))).alias(f) for f in fields])


def ordered_refusals(ignored: DataFrame) -> DataFrame:
    """By floor, missing ones last, then by post id and stage in natural order."""
    text = lambda c: natural_key(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return ignored.orderBy(F.asc_nulls_last("lou"), text("pid"), text("stage"))


def generated_label(c: Column) -> Column:
    """A time as year-month-day hour:minute:second; text that is none stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd HH:mm:ss"), c)


def entry_notes(entries: DataFrame) -> DataFrame:
    """Adds notes: what a reader of a sheet should know, a line each."""
    sure = F.when(F.col("confidence") < 1, F.concat(F.lit("置信度 "), percent_label(F.col("confidence"))))
    older = F.when(F.size("superseded_lous") > 0, F.concat(F.lit("覆盖楼层 "), floor_label(F.col("superseded_lous"), F.col("chosen_lou"))))
    return entries.withColumn("notes", F.concat_ws("\n", F.nullif(F.col("note"), F.lit("")), F.col("proxy"), older, sure))
