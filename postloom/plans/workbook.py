"""Sheets as files: a folder for each with its rows as CSV in parts and its layout as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.markup import sheet_title
from postloom.functions.scalars import row_height
from postloom.operators.numbering import dense_number, unique_titles
from postloom.plans.views import field_headers, sheet_cells, sheet_widths, topics_in_order

#: Rows of a part.
ROWS = 10_000
#: Headings and column widths of the older book.
OLD_ROWS = (("编号", None), ("作者ID", 10), ("作者名称", 15), ("安价楼层", None), ("安价内容", 100), ("是否有可能重复安价", 20))
OLD_REFUSED = (("作者ID", None), ("作者名称", 10), ("楼层", None), ("内容", 100), ("忽略原因", None))


def csv_line(cells: Column) -> Column:
    """Every cell in double quotes, so that breaks and commas stay in it."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))), ",")


def sheet_files(rows: DataFrame) -> DataFrame:
    """(path, body) of rows (sheet, row_no, cells): parts of ROWS rows in order."""
    part = F.floor(F.col("row_no") / ROWS)
    parts = rows.groupBy("sheet", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("row_no", csv_line(F.col("cells")).alias("line")))).alias("x"))
    return parts.select(F.format_string("%s/rows_%05d.csv", "sheet", "part").alias("path"), F.concat(F.array_join("x.line", "\n"), F.lit("\n")).alias("body"))


def workbook(entries: DataFrame, topics: DataFrame, cap: int = 60) -> DataFrame:
    """(path, body) of a book with a sheet for each topic in order, those without entries and unknown ones included. entries: as of sheet_cells.

    A layout says what is fixed and filtered, that headings are bold, and how wide columns are.
    """
    order = topics_in_order(topics, entries)
    labels = order.join(topics.select("topic_id", F.nullif("short_name", F.lit("")).alias("short")), "topic_id", "left")
    titles = labels.select("topic_id", sheet_title(F.concat(F.lpad(F.col("place").cast("string"), 2, "0"), F.lit("_"), F.coalesce("short", F.nullif("topic_name", F.lit("")), "topic_id")), "主题").alias("title"), F.col("place").alias("ord"))
    sheets = unique_titles(titles).select("topic_id", "sheet")
    cells = sheet_cells(entries, field_headers(entries, of=order))
    widths = sheet_widths(cells, cap).groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "width"))), lambda x: x["width"]).alias("widths"))
    layout = sheets.join(widths, "topic_id", "left").select(F.concat("sheet", F.lit("/layout.json")).alias("path"), F.to_json(F.struct("sheet", F.lit("A2").alias("freeze"), F.lit(True).alias("filter"), F.lit(True).alias("bold_headings"), "widths")).alias("body"))
    return sheet_files(cells.join(sheets, "topic_id").select("sheet", "row_no", "cells")).unionByName(layout)


def _placed(rows: DataFrame, sheet: str, cells: list[Column], text: str, unit: int, marked: Column, order: list[str]) -> DataFrame:
    numbered = dense_number(rows, "row_no", F.lit(0), F.col(order[0]), order[1:])
    shown = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells])
    return numbered.select(F.lit(sheet).alias("sheet"), "row_no", shown.alias("cells"), row_height(F.length(F.coalesce(text, F.lit(""))), unit).alias("height"), marked.alias("marked"))


def older_book(rows: DataFrame, refused: DataFrame) -> DataFrame:
    """(sheet, row_no, cells, height, marked) of the older tally's two sheets; row 0 has the headings. marked: the author's name stands out.

    rows: author_number, uid, username, lou, text, maybe_duplicate; refused: uid, username, lou, text, ignore_reason.
    """
    twice = F.coalesce("maybe_duplicate", F.lit(False))
    own = _placed(rows, "Sheet1", [F.col("author_number"), F.col("uid"), F.col("username"), F.col("lou"), F.col("text"), F.when(twice, "是").otherwise("")], "text", 50, twice, ["author_number", "lou"])
    lost = _placed(refused, "Ignored", [F.col(c) for c in ("uid", "username", "lou", "text", "ignore_reason")], "text", 25, F.lit(False), ["lou", "uid"])
    heads = rows.sparkSession.createDataFrame([(s, 0, [h for h, _ in c], None, False) for s, c in (("Sheet1", OLD_ROWS), ("Ignored", OLD_REFUSED))], "sheet string, row_no long, cells array<string>, height long, marked boolean")
    return own.unionByName(lost).unionByName(heads)
