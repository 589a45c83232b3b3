"""Registered queries of what readers see: hits in natural order, sheets, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions.entities import unescaped
from postloom.functions.markup import clean_legacy
from postloom.functions.scalars import percent_shown
from postloom.operators import anchors
from postloom.plans import legacy, views, workbook
from postloom.queries import ENTRIES, POSTS, RULE, TOPICS, entries, posts, query, table, talk
from postloom.rules import Topic


@query(
    """with h as (select distinct o_custkey lou, o_orderkey % 3 chosen, o_orderkey k from orders), r as (select distinct o_custkey lou, o_orderkey % 1000 k from orders),
    a as (select lou, string_agg(chosen || ':item ' || k || '号', '|' order by chosen, k) topic_hits from h group by 1), b as (select lou, string_agg('Late ' || k || 'x', '|' order by k) ignore_hits from r group by 1)
    select lou, topic_hits, ignore_hits from a join b using (lou)"""
)
def review_hits(spark, sf_dir):
    """Labels and reasons that differ by their numbers alone come in order of these."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    e = o.select(F.array("o_custkey").alias("source_lous"), (key % 3).alias("chosen_lou"), F.concat(F.lit("item "), key.cast("string"), F.lit("号")).alias("topic_name"))
    i = o.select(F.col("o_custkey").alias("lou"), F.concat(F.lit("Late "), (key % 1000).cast("string"), F.lit("x")).alias("ignore_reason"))
    out = views.review_hits(e, i)
    shown = F.transform("topic_hits", lambda h: F.concat(h["chosen_lou"].cast("string"), F.lit(":"), h["label"]))
    return out.select("lou", F.array_join(shown, "|").alias("topic_hits"), F.array_join("ignore_hits", "|").alias("ignore_hits"))


def sheet_entries(spark, sf_dir):
    e = entries(spark, sf_dir)
    k = F.col("k").cast("string")
    fields = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("k"), k, F.lit("even"), F.lit('["a", 2.0]'))).otherwise(F.create_map(F.lit("k"), F.concat(F.lit('"'), k, F.lit('"'))))
    none = F.lit(None).cast("string")
    return e.withColumns({"fields": fields, "source_lous": F.array("lou", "k"), "needs_manual_review": F.col("k") > 95, "target": none, "target_lou": none, "target_author": none, "notes": F.lit("n"), "url": none})


@query(
    f"""with r as (select *, row_number() over (partition by topic_id order by k, entry_id) row_no from ({ENTRIES}))
    select topic_id, row_no, concat_ws('|', row_no, k, postdate, username, uid, k, case when k % 2 = 0 then 'a' || chr(10) || '2' else '' end, content, '#' || lou || ', #' || k, '', '', '', case when k > 95 then '是' else '' end, 'n', '') cells from r
    union all select distinct topic_id, 0, '序号|投稿楼层|发布时间|作者|UID|k|even|统计结果|来源楼层|加权目标|加权目标楼层|加权目标作者|需要复核|备注|链接' from r"""
)
def sheet_cells(spark, sf_dir):
    """Sheets with all fixed columns and the fields that any entry of the topic has."""
    e = sheet_entries(spark, sf_dir)
    cells = views.sheet_cells(e, views.field_headers(e))
    return cells.select("topic_id", "row_no", F.array_join("cells", "|").alias("cells"))


@query(
    f"""with r as (select *, row_number() over (partition by topic_id order by k, entry_id) row_no from ({ENTRIES})),
    c as (select topic_id, unnest([length(row_no::varchar), length(k::varchar), length(postdate), length(username), length(uid::varchar), length(k::varchar), case when k % 2 = 0 then 3 else 0 end, length(content), length('#' || lou || ', #' || k), 0, 0, 0, (k > 95)::int, 1, 0]) n, unnest(range(15)) col from r where row_no < 200
      union all select distinct topic_id, unnest([2, 4, 4, 2, 3, 1, 4, 4, 4, 4, 6, 6, 4, 2, 2]), unnest(range(15)) from r)
    select topic_id, col::int as "column", least(60, greatest(10, max(n) + 2))::int width from c group by 1, 2"""
)
def sheet_widths(spark, sf_dir):
    e = sheet_entries(spark, sf_dir)
    return views.sheet_widths(views.sheet_cells(e, views.field_headers(e)))


@query(
    """with t(topic_id, topic_name, ord) as (values ('view', 'View', 0), ('click', 'Click', 1), ('none', 'None', 2)), o as (select distinct event_type topic_id, event_type topic_name from events where event_type not in (select topic_id from t)),
    a as (select topic_id, topic_name, 0 kind, ord from t union all select topic_id, topic_name, 1, 0 from o)
    select topic_id, topic_name, row_number() over (order by kind, ord, topic_id) place from a"""
)
def topics_in_order(spark, sf_dir):
    topics = anchors.topic_table(spark, (*TOPICS[:2], Topic("none", "None", "none")))
    return views.topics_in_order(topics, posts(spark, sf_dir).select("topic_id", F.col("lou").alias("entry_id")))


@query(f"select lou, case when k % 7 = 0 then '待复核' else floor(k / 200.0 * 100 + 0.5)::int || '%' end shown from ({POSTS})")
def percents_shown(spark, sf_dir):
    return posts(spark, sf_dir).select("lou", percent_shown(F.when(F.col("k") % 7 != 0, F.col("k") / 200)).alias("shown"))


@query(
    f"""with r as (select * from ({POSTS}) where lou > 100 and uid not in (3, 7, 11) and postdate <= '2024-01-20 12:00' and lou not in (500, 501, 777)), a as (select author_key, min(lou) f, count(*) n from r group by 1), b as (select *, row_number() over (order by f, author_key) author_number from a),
    x as (select 'Sheet1' sheet, row_number() over (order by author_number, lou) row_no, concat_ws('|', author_number, uid, username, lou, trim(content), case when n > 1 then '是' else '' end) cells, (length(trim(content)) // 100 + 1) * 50 height, n > 1 marked from r join b using (author_key)),
    y as (select 'Ignored' sheet, row_number() over (order by lou) row_no, concat_ws('|', uid, username, lou, trim(content), case when lou <= 100 then '楼层 ' || lou || ' 小于等于起始楼层 100' when uid in (3, 7, 11) then '作者' || username || '在忽略名单中' when postdate > '2024-01-20 12:00' then '时间 ' || postdate || ' 超过截止时间 2024-01-20 12:00' else '楼层 ' || lou || ' 在忽略楼层名单中' end) cells, (length(trim(content)) // 100 + 1) * 25 height, false marked from ({POSTS}) where lou not in (select lou from r))
    select * from x union all select * from y union all select 'Sheet1', 0, '编号|作者ID|作者名称|安价楼层|安价内容|是否有可能重复安价', null, false union all select 'Ignored', 0, '作者ID|作者名称|楼层|内容|忽略原因', null, false"""
)
def older_sheets(spark, sf_dir):
    rows, refused = legacy.legacy_tally(posts(spark, sf_dir), RULE)
    refused = refused.withColumn("text", clean_legacy(F.col("content")))
    return workbook.older_book(rows, refused).select("sheet", "row_no", F.array_join("cells", "|").alias("cells"), "height", "marked")


@query(
    """select conv_id, turn, '<' || role || 'A©¬it; &<é\U0001f437€&unknown;' || chr(160) || '�' || 'fj∾̳' once, '<' || role || 'A©¬it; &<é\U0001f437€&unknown;' || chr(160) || '�' || 'fj∾̳' twice from conversations"""
)
def references(spark, sf_dir):
    """Named, numbered, unended and unknown character references."""
    text = F.concat(F.lit("&lt;"), "role", F.lit("&#x41;&copy;&notit; &amp;&lt&#233;&#x1F437;&#128;&unknown;&nbsp;&#xD800;&fjlig;&acE;"))
    once = unescaped(text)
    return talk(spark, sf_dir).select("conv_id", "turn", once.alias("once"), unescaped(once).alias("twice"))


@query(
    f"""with r as (select * from ({POSTS}) where lou > 100 and uid not in (3, 7, 11) and postdate <= '2024-01-20 12:00' and lou not in (500, 501, 777))
    select p.n posts, a.n authors, p.n - r.n refused, a.n + p.n - r.n = p.n adds_up from (select count(*) n from ({POSTS})) p, (select count(*) n from r) r, (select count(distinct author_key) n from r) a"""
)
def reconciliation(spark, sf_dir):
    p = posts(spark, sf_dir)
    return legacy.reconciliation(p, *legacy.legacy_tally(p, RULE))


@query(
    f"""select lou, concat_ws(chr(10), case when k % 3 = 0 then 'n' || k end, case when k % 5 = 0 then '文本包含“代发安价”' end, case when k % 2 = 0 then '覆盖楼层 #' || k || ', #' || (k + 1) end,
      case when k < 50 then '置信度 ' || (2 * k)::varchar || '%' end) notes from ({POSTS})"""
)
def entry_notes(spark, sf_dir):
    k = F.col("k")
    older = F.when(k % 2 == 0, F.array(k, k + 1)).otherwise(F.array().cast("array<bigint>"))
    rows = posts(spark, sf_dir).select("lou", F.col("lou").alias("chosen_lou"), (k / 50).alias("confidence"), older.alias("superseded_lous"), F.when(k % 3 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("note"), F.when(k % 5 == 0, F.lit("文本包含“代发安价”")).alias("proxy"))
    return views.entry_notes(rows).select("lou", "notes")
