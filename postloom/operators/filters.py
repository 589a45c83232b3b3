"""Which posts count: every reason that a post is refused for, or the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.matching import has_qa_marker
from postloom.functions.markup import strip
from postloom.rules import Rule

SEPARATOR = "；"


def _in(c: Column, values) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(False)


def all_reasons(rule: Rule, text: Column, raw: Column | None = None) -> Column:
    """Reasons in fixed order, joined; empty where the post counts. Deadlines are compared as text."""
    lou, uid, date = F.col("lou"), F.col("uid"), F.col("postdate")
    checks = [
        F.when(lou.isNull(), F.lit("楼层号缺失")),
        F.when(lou <= rule.start_lou, F.format_string(f"楼层 %d 小于等于起始楼层 {rule.start_lou}", lou)),
    ]
    if rule.end_lou is not None:
        checks.append(F.when(lou > rule.end_lou, F.format_string(f"楼层 %d 大于结束楼层 {rule.end_lou}", lou)))
    checks += [
        F.when(_in(lou, rule.not_anjia_lou_list), F.format_string("楼层 %d 在忽略楼层名单中", lou)),
        F.when(_in(uid, rule.ignore_author_user), F.format_string("作者 uid=%d 在忽略名单中", uid)),
    ]
    if rule.end_time is not None:
        checks.append(F.when(date > rule.end_time, F.format_string(f"时间 %s 超过截止时间 {rule.end_time}", date)))
    if rule.keyword is not None:
        raw = text if raw is None else raw
        checks.append(F.when(~F.contains(F.coalesce(text, F.lit("")), F.lit(rule.keyword)) & ~F.contains(F.coalesce(raw, F.lit("")), F.lit(rule.keyword)), F.lit(f"不包含关键词 {rule.keyword}")))
    checks.append(F.when(F.coalesce(strip(text), F.lit("")) == "", F.lit("清洗后内容为空")))
    return F.concat_ws(SEPARATOR, *checks)


def split_posts(posts: DataFrame, rule: Rule, text: str = "content", raw: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates, and refused posts with ignore_reason and stage; both read one projection, no shuffle."""
    judged = posts.withColumn("ignore_reason", all_reasons(rule, F.col(text), F.col(raw) if raw else None))
    return judged.where("ignore_reason = ''").drop("ignore_reason"), judged.where("ignore_reason <> ''").withColumn("stage", F.lit("deterministic"))


def first_reason(rule: Rule) -> Column:
    """The older tally's single reason, in its own order; null where the post counts."""
    lou, uid, date = F.col("lou"), F.col("uid"), F.col("postdate")
    out = F.when(lou <= rule.start_lou, F.format_string(f"楼层 %d 小于等于起始楼层 {rule.start_lou}", lou))
    out = out.when(_in(uid, rule.ignore_author_user), F.format_string("作者%s在忽略名单中", F.col("username")))
    if rule.end_time is not None:
        out = out.when(date > rule.end_time, F.format_string(f"时间 %s 超过截止时间 {rule.end_time}", date))
    return out.when(_in(lou, rule.not_anjia_lou_list), F.format_string("楼层 %d 在忽略楼层名单中", lou))


def qa_without_marker(topic: Column, has_quote: Column, text: Column, post: Column) -> Column:
    """A question inside a reply that names neither question nor addressee."""
    return (topic == "qa") & has_quote & ~has_qa_marker(text) & ~has_qa_marker(post)


def matches(search: Column, term: str) -> Column:
    term = term.strip().lower()
    return F.lit(True) if not term else F.contains(search, F.lit(term))
