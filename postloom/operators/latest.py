"""The newest submission of an author to a topic holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(proposals: DataFrame, exempt: str = "false") -> tuple[DataFrame, DataFrame]:
    """(kept, superseded). proposals: author_key, topic_id, chosen_lou, ord, source_lous.

    Rows for which `exempt` holds (topics that allow several, submissions for others) are
    kept and group with nothing. Of the others the greatest chosen_lou wins, last in order
    of `ord` on ties; winners get superseded_lous, losers superseded_by_lou.
    """
    free = F.coalesce(F.expr(exempt), F.lit(False))
    out = proposals.withColumn("_free", free)
    group = Window.partitionBy("author_key", "topic_id", "_free", F.when(F.col("_free"), F.col("ord")))
    order = group.orderBy(F.desc("chosen_lou"), F.desc("ord"))
    out = out.withColumn("_rank", F.row_number().over(order)).withColumn("_winner", F.first("chosen_lou").over(order))
    lost = out.where("_rank > 1").withColumn("superseded_by_lou", F.col("_winner")).drop("_free", "_rank", "_winner")
    older = lost.select(F.col("author_key").alias("_author"), F.col("topic_id").alias("_topic"), F.explode("source_lous").alias("_lou"))
    older = older.groupBy("_author", "_topic").agg(F.array_sort(F.collect_set("_lou")).alias("superseded_lous"))
    kept = out.where("_rank = 1").join(older, F.col("author_key").eqNullSafe(F.col("_author")) & F.col("topic_id").eqNullSafe(F.col("_topic")) & ~F.col("_free"), "left")
    kept = kept.withColumn("superseded_lous", F.coalesce("superseded_lous", F.array().cast(dict(lost.dtypes)["source_lous"])))
    kept = kept.drop("_free", "_rank", "_winner", "_author", "_topic")
    return kept, lost


def superseded_rows(lost: DataFrame) -> DataFrame:
    """Refused rows, one for each source floor of a superseded submission."""
    rows = lost.select("author_key", "topic_id", "chosen_lou", "superseded_by_lou", F.explode("source_lous").alias("lou"))
    return rows.withColumns({"ignore_reason": F.format_string("被同一作者的更新楼层 %d 覆盖", F.col("superseded_by_lou")), "stage": F.lit("superseded")})
