"""Registered queries: each operator on the given tables, with its SQL twin.

events stand in for posts (event_id: floor, user_id: author, event_type: topic, ts: date),
conversations for threads of text, pages for markup, labels for the floors that are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import markup as m
from postloom.functions import matching as mt
from postloom.functions import scalars as sc
from postloom.operators import anchors, filters, gaps, latest, links, numbering, packs, targets
from postloom.plans import archive, legacy, tally, views
from postloom.rules import Rule, Topic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOPICS = tuple(Topic(t, t.title(), t[:4], allow_multiple_per_author=t == "view") for t in ("view", "click", "signup", "purchase"))
RULE = Rule(start_lou=100, end_lou=9000, end_time="2024-01-20 12:00", ignore_author_user=(3, 7, 11), not_anjia_lou_list=(500, 501, 777), keyword=None, topics=TOPICS)
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("ord"),
        F.col("event_id").alias("lou"),
        F.col("event_id").alias("pid"),
        F.col("user_id").alias("uid"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"),
        F.concat(F.lit("uid:"), F.col("user_id").cast("string")).alias("author_key"),
        F.col("event_type").alias("topic_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("postdate"),
        F.col("props").alias("content"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


POSTS = "select event_id ord, event_id lou, event_id pid, user_id uid, 'user' || user_id username, 'uid:' || user_id author_key, event_type topic_id, strftime(ts, '%Y-%m-%d %H:%M') postdate, props as content, cast(props->>'$.k' as bigint) k from events"


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


# --- markup and text


@query(
    r"""with a as (select page_id, regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g') h from pages),
    b as (select page_id, regexp_replace(regexp_replace(h, '(?i)</(?:p|div|li|tr|h[1-6])>', chr(10), 'g'), '(?is)\[img\].*?\[/img\]', '', 'g') h from a),
    c as (select page_id, regexp_replace(h, '<[^>]+>', '', 'g') h from b),
    d as (select page_id, regexp_replace(regexp_replace(h, '(?i)\[/?(?:quote|b|i|u|s|del|color|size|align|url|collapse|fold|pid|tid)[^\]]*\]', '', 'g'), '(?i)\[(?:/?[A-Za-z*][^\]]*|s:[^\]]+)\]', '', 'g') h from c),
    e as (select page_id, replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') h from d),
    f as (select page_id, replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') h from e),
    g as (select page_id, regexp_replace(regexp_replace(replace(regexp_replace(h, '\r\n?', chr(10), 'g'), chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') h from f)
    select page_id, md5(regexp_replace(h, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) digest, length(regexp_replace(h, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))::bigint n from g"""
)
def clean_html(spark, sf_dir):
    text = m.clean_post(F.col("html"), m.unescaped_basic)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("digest"), F.length(text).cast("long").alias("n"))


@query()
def clean_html_exact(spark, sf_dir):
    """All HTML entities; SQL has no counterpart."""
    text = m.clean_post(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("digest"), F.length(text).cast("long").alias("n"))


@query(
    r"""with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '<br>|<br/>|<br />', chr(10), 'g'), '<[^>]+>', '', 'g'), '(?s)\[img\].*?\[/img\]', '', 'g') h from pages),
    b as (select page_id, replace(regexp_replace(h, '\[/?[^\]]+\]', '', 'g'), '&quot;', '"') h from a)
    select page_id, md5(regexp_replace(h, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) digest from b"""
)
def clean_legacy(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(m.clean_legacy(F.col("html"))).alias("digest"))


def marked(c: str) -> Column:
    return F.concat(F.lit("[quote][quote]"), c, F.lit("[/quote][/quote][b][i]x[/i]y[/b][url=http://a/b]t[/url][img]u.png[/img][color=red]c[/color][size=2]s[/size]"))


@query(
    "select conv_id, turn, md5('<blockquote><blockquote>' || text || '</blockquote></blockquote><strong><em>x</em>y</strong><a href=\"http://a/b\">t</a><img src=\"u.png\" alt=\"\" /><span style=\"color:red\">c</span><span style=\"font-size:2\">s</span>') digest from conversations"
)
def bbcode_to_html(spark, sf_dir):
    return talk(spark, sf_dir).select("conv_id", "turn", F.md5(m.bbcode_to_html(marked("text"))).alias("digest"))


@query(r"select conv_id, turn, md5(regexp_replace('[b]' || text || '[/b][url=x]y[/url]', '\[/?[a-zA-Z]+(?:=[^\]]+)?\]', '', 'g')) digest from conversations")
def strip_bbcode(spark, sf_dir):
    return talk(spark, sf_dir).select("conv_id", "turn", F.md5(m.without_bbcode(F.concat(F.lit("[b]"), "text", F.lit("[/b][url=x]y[/url]")))).alias("digest"))


QUOTED = "'[quote][pid=' || (conv_id * 100 + turn) || ',' || conv_id || ',' || (turn + 1) || ']Reply[/pid] <b>Post by [uid=5]' || role || '[/uid] (2024-01-01 10:00):</b><br/>' || text || '[/quote]ok'"


@query(
    rf"""select conv_id, turn, 1 n, conv_id * 100 + turn as pid, conv_id tid, turn + 1 page, role author,
    md5(case when length(t) > 160 then substr(t, 1, 160) || chr(10) || '...[已截断]' else t end) preview, md5('ok') rest from (
      select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[ \t]+\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^[ \n：:]+|[ \n：:]+$', '', 'g') t
      from conversations)"""
)
def reply_context(spark, sf_dir):
    rows = talk(spark, sf_dir).withColumn("post", F.expr(QUOTED))
    r = m.reply_context(F.col("post"), m.unescaped_basic)
    out = rows.select("conv_id", "turn", r.alias("r"), F.md5(m.without_reply_quotes(F.col("post"))).alias("rest"))
    return out.select("conv_id", "turn", F.col("r.reply_quote_count").alias("n"), F.col("r.reply_to_pid").alias("pid"), F.col("r.reply_to_tid").alias("tid"), F.col("r.reply_to_page").alias("page"), F.col("r.reply_to_author").alias("author"), F.md5("r.quoted_preview").alias("preview"), "rest")


@query(
    r"""with c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n：:]+|[ \n：:]+$', '', 'g') t from documents)
    select doc_id, md5(t) compacted, md5(case when length(t) > 200 then substr(t, 1, 200) || chr(10) || '...[已截断]' else t end) truncated, case when length(t) > 50 then substr(t, 1, 50) || '...' else t end snippet from c"""
)
def compact_text(spark, sf_dir):
    c = m.compact(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(c).alias("compacted"), F.md5(m.truncated(c, 200)).alias("truncated"), m.snippet(c, 50).alias("snippet"))


@query(r"select doc_id, md5(regexp_replace(lower(text), '[^0-9a-z一-鿿]+', '', 'g')) form, md5(regexp_replace(lower(text), '[\s\p{Z}]+', '', 'g')) keyword from documents")
def match_forms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(mt.match_form(F.col("text"))).alias("form"), F.md5(mt.keyword_form(F.col("text"))).alias("keyword"))


@query(
    r"""with n as (select doc_id, regexp_replace(lower(text || case doc_id % 5 when 0 then ' 代 发一个安价' when 1 then '帮人 安价' when 2 then '群友的安价代发' else ' Q & A' end), '[\s\p{Z}]+', '', 'g') t, doc_id % 5 r from documents)
    select doc_id, case when contains(t, '群友的安价代发') then '文本包含“群友的安价代发”' when contains(t, '帮别人安价') or contains(t, '帮人安价') then '文本包含“帮别人安价”' when contains(t, '代发') and contains(t, '安价') then '文本包含“代发安价”' end proxy,
    contains(t, 'q&a') or contains(t, 'qa') qa from n"""
)
def marker_flags(spark, sf_dir):
    text = F.expr("text || case doc_id % 5 when 0 then ' 代 发一个安价' when 1 then '帮人 安价' when 2 then '群友的安价代发' else ' Q & A' end")
    return table(spark, sf_dir, "documents").select("doc_id", mt.proxy_reason(text).alias("proxy"), mt.has_qa_marker(text).alias("qa"))


@query(
    r"""with t as (select conv_id, turn, case turn % 3 when 0 then '安价：加权 ' || role when 1 then '加权一下！' else role || ' says' end s from conversations)
    select conv_id, turn, case when regexp_matches(s, '^(?:安价[：: ]*)?加(?:个)?权(?:[：: ]+)?.+$') then regexp_extract(s, '^(?:安价[：: ]*)?加(?:个)?权(?:[：: ]+)?(.+)$', 1) end hint,
      regexp_matches(s, '加(?:个)?权') asks, regexp_full_match(s, '(?:安价[：: ]*)?加权(?:一下|1下)?[。！!？?~…]*') only_weight from t"""
)
def weight_hints(spark, sf_dir):
    s = F.expr("case turn % 3 when 0 then '安价：加权 ' || role when 1 then '加权一下！' else role || ' says' end")
    return talk(spark, sf_dir).select("conv_id", "turn", mt.weight_hint(s).alias("hint"), mt.asks_weight(s).alias("asks"), mt.is_weight_only(s).alias("only_weight"))


@query(
    "select event_id, case event_type when 'view' then 'theme1_travel' when 'click' then 'qa' else lower(replace(replace(event_type, ' ', '_'), '-', '_')) end topic, case event_type when 'view' then '主题1：旅行' when 'click' then '特别环节：诡秘小祥一周年 Q&A' else event_type end topic_name from events"
)
def topic_alias(spark, sf_dir):
    from postloom.rules import ALIASES
    from postloom.rules import TOPICS as DEFAULT

    raw = F.when(F.col("event_type") == "view", " 旅游 ").when(F.col("event_type") == "click", "Q&A").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", mt.topic_id(raw, ALIASES).alias("topic_id"))
    return anchors.topic_names(rows, anchors.topic_table(spark, DEFAULT)).select("event_id", F.col("topic_id").alias("topic"), "topic_name")


@query("select conv_id, turn, 'p' || conv_id || '.png' name, '.png' ext, 'https://ngabbs.com/read.php?pid=' || turn || '&opt=128' url, conv_id % 2 = 0 valid, '#' || turn || ', #' || (turn + 1) floors, case when role = '' then 'uid:' || conv_id else role end author from conversations")
def link_labels(spark, sf_dir):
    url = F.concat(F.when(F.col("conv_id") % 2 == 0, "https://img.nga.178.com/attachments/mon_202601/07/p").otherwise("https://img.nga.178.com/x/p"), F.col("conv_id").cast("string"), F.lit(".png"))
    name = m.file_name(F.concat(url, F.lit("?v=1")))
    return talk(spark, sf_dir).select("conv_id", "turn", name.alias("name"), m.extension(name).alias("ext"), m.post_url(F.col("turn")).alias("url"), m.is_image_link(url).alias("valid"), m.floor_label(F.array(F.col("turn"), F.col("turn") + 1), F.col("turn")).alias("floors"), m.author_label(F.col("role"), F.col("conv_id")).alias("author"))


# --- numbers, arrays, JSON

INTS = "case event_id % 6 when 0 then ' 12 ' when 1 then '+7' when 2 then '3.0' when 3 then 'x1' when 4 then '-' || event_id else '' end"


@query(
    f"with t as (select event_id, value, {INTS} s from events) select event_id, case when regexp_full_match(s, '\\s*[+-]?[0-9]+\\s*') then cast(trim(s) as bigint) end n, greatest(0.0, least(1.0, value / 100)) conf, event_id // 20 + 1 as page, case when event_id % 2 = 0 then '是' else '' end flag, (event_id // 100 + 1) * 25 as height from t"
)
def numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", F.expr(INTS))
    return e.select("event_id", sc.to_int(F.col("s")).alias("n"), sc.confidence(F.col("value") / 100).alias("conf"), sc.page_of(F.col("event_id")).alias("page"), sc.flag_label(F.col("event_id") % 2 == 0).alias("flag"), sc.row_height(F.col("event_id")).cast("long").alias("height"))


@query(
    "with g as (select p_partkey, p_size * 40 w, cast(p_retailprice * 4 as int) h from part) select p_partkey, greatest(w, h) <= 420 and h / greatest(w, 1) >= 0.45 and h / greatest(w, 1) <= 3.0 portrait, w >= 800 and h / greatest(w, 1) >= 4.0 long_image, case when h <= greatest(1, cast(floor(w * 1.35) as int)) then 0 else ((h - 1) // greatest(1, cast(floor(w * 1.35) as int)) + 1) end::int slices from g"
)
def image_shapes(spark, sf_dir):
    g = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40).alias("w"), F.round(F.col("p_retailprice") * 4).cast("int").alias("h"))
    w, h = F.col("w"), F.col("h")
    return g.select("p_partkey", sc.is_portrait(w, h).alias("portrait"), sc.is_long(w, h).alias("long_image"), F.size(sc.slice_starts(w, h)).alias("slices"))


@query("select o_custkey, string_agg(k, ',' order by k) keys from (select distinct o_custkey, o_orderkey k from orders) group by 1")
def int_lists(spark, sf_dir):
    raw = F.concat(F.collect_list(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))), F.collect_list(F.col("o_orderkey").cast("string")), F.array(F.lit("x"), F.lit("1.5")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(raw.alias("raw")).select("o_custkey", F.array_join(sc.int_list(F.col("raw")).cast("array<string>"), ",").alias("keys"))


@query("select event_id, case when event_id % 4 = 3 then null else cast(props->>'$.k' as bigint) end k from events")
def json_lenient(spark, sf_dir):
    raw = F.expr("case event_id % 4 when 0 then props when 1 then '```json\n' || props || '\n```' when 2 then 'text ' || props || ' more' else '[1, 2]' end")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(sc.json_object(raw), "$.k").cast("long").alias("k"))


@query("with v as (select o_custkey, o_orderpriority v, min(o_orderkey) f from orders group by 1, 2) select o_custkey, string_agg(v, ',' order by f) names from v group by 1")
def distinct_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    return rows.select("o_custkey", F.array_join(sc.without_prefixes(sc.distinct_by(F.col("x.o_orderpriority"), mt.keyword_form)), ",").alias("names"))


@query()
def carriage_names(spark, sf_dir):
    """Names after a label; a fold over lines, tested against a plain version."""
    text = F.expr("'马车名字：' || role || '、' || role || conv_id || '\n再来一个：\n' || role || turn || '号'")
    return talk(spark, sf_dir).select("conv_id", "turn", F.array_join(mt.names_in(text, m.unescaped_basic), "|").alias("names"))


# --- filters

REASONS = """concat_ws('；', case when lou <= 100 then '楼层 ' || lou || ' 小于等于起始楼层 100' end, case when lou > 9000 then '楼层 ' || lou || ' 大于结束楼层 9000' end, case when lou in (500, 501, 777) then '楼层 ' || lou || ' 在忽略楼层名单中' end,
  case when uid in (3, 7, 11) then '作者 uid=' || uid || ' 在忽略名单中' end, case when postdate > '2024-01-20 12:00' then '时间 ' || postdate || ' 超过截止时间 2024-01-20 12:00' end, case when trim(content) = '' then '清洗后内容为空' end)"""


@query(f"select lou, {REASONS} ignore_reason, 'deterministic' stage from ({POSTS}) where {REASONS} <> ''")
def reason_split_all(spark, sf_dir):
    return filters.split_posts(posts(spark, sf_dir), RULE)[1].select("lou", "ignore_reason", "stage")


@query(f"select lou, author_key, topic_id from ({POSTS}) where {REASONS} = ''")
def candidates(spark, sf_dir):
    return filters.split_posts(posts(spark, sf_dir), RULE)[0].select("lou", "author_key", "topic_id")


@query(
    f"select lou, case when lou <= 100 then '楼层 ' || lou || ' 小于等于起始楼层 100' when uid in (3, 7, 11) then '作者' || username || '在忽略名单中' when postdate > '2024-01-20 12:00' then '时间 ' || postdate || ' 超过截止时间 2024-01-20 12:00' when lou in (500, 501, 777) then '楼层 ' || lou || ' 在忽略楼层名单中' end ignore_reason from ({POSTS})"
)
def reason_split_first(spark, sf_dir):
    return posts(spark, sf_dir).select("lou", filters.first_reason(RULE).alias("ignore_reason"))


@query("select doc_id, lang from documents where contains(lower(coalesce(lang, '') || ' ' || coalesce(source, '') || ' ' || coalesce(text, '')), 'idiot') or contains(lower(coalesce(lang, '') || ' ' || coalesce(source, '') || ' ' || coalesce(text, '')), 'src1 ')")
def search_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("search", m.search_text(F.col("lang"), F.col("source"), F.col("text")))
    return rows.where(filters.matches(F.col("search"), " Idiot ") | F.contains("search", F.lit("src1 "))).select("doc_id", "lang")


# --- packs and joins


@query(f"select author_key, string_agg(lou, ',' order by lou) lous, min(lou) first_lou, count(*) n from ({POSTS}) group by 1")
def author_packs(spark, sf_dir):
    p = packs.author_packs(posts(spark, sf_dir))
    return p.select("author_key", F.array_join(F.col("posts.lou").cast("array<string>"), ",").alias("lous"), "first_lou", F.size("posts").cast("long").alias("n"))


@query(
    f"""with p as ({POSTS}), l as (select distinct c.author_key, p.pid, c.lou from p c join p on c.k * 10 = p.pid where not exists (select 1 from p o where o.author_key = c.author_key and o.pid = p.pid))
    select author_key, pid, string_agg(lou, ',' order by lou) linked from l group by 1, 2"""
)
def pack_context(spark, sf_dir):
    p = posts(spark, sf_dir)
    asked = p.select("author_key", "lou", "pid", (F.col("k") * 10).alias("reply_to_pid"))
    return packs.reply_context_posts(asked, p).select("author_key", "pid", F.array_join(F.col("linked_from_lous").cast("array<string>"), ",").alias("linked"))


@query(
    f"""with p as ({POSTS}), i as (select author_key, lou item_no, unnest([lou, lou + 1, k]) s, k chosen from p), f as (select i.*, p.lou found from i join p on p.author_key = i.author_key and p.lou = i.s),
    g as (select author_key, item_no, string_agg(distinct found, ',' order by found) lous, max(found) mx, bool_or(found = chosen) has, max(chosen) chosen from f group by 1, 2)
    select author_key, item_no, lous, case when has then chosen else mx end chosen_lou from g"""
)
def item_sources(spark, sf_dir):
    p = posts(spark, sf_dir)
    items = p.select("author_key", F.col("lou").alias("item_no"), F.array(F.col("lou"), F.col("lou") + 1, F.col("k")).alias("source_lous"), F.col("k").alias("chosen_lou"))
    return links.item_sources(items, p).select("author_key", "item_no", F.array_join(F.col("source_lous").cast("array<string>"), ",").alias("lous"), "chosen_lou")


@query("select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1) and doc_id not in (select doc_id from labels where toxic = 1)")
def uncovered_floors(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "lou")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("lou"))
    return links.uncovered(docs, lab.where("quality = 1"), lab.where("toxic = 1")).select(F.col("lou").alias("doc_id"))


@query("select l_suppkey lou, l_returnflag topic_id, min(l_orderkey * 10 + l_linenumber) ord from lineitem where (l_suppkey, l_returnflag) not in (select l_suppkey, l_returnflag from lineitem where l_quantity >= 50) group by 1, 2")
def new_pairs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("lou"), F.col("l_returnflag").alias("topic_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "l_quantity")
    return links.new_pairs(li, li.where("l_quantity >= 50")).select("lou", "topic_id", "ord")


@query("with h as (select page_id, sha256(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) h, lpad(page_id::varchar, 9, '0') f from pages) select f filename, min(f) over (partition by h) canonical from h")
def canonical_files(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    files = table(spark, sf_dir, "pages").select(F.lpad(F.col("page_id").cast("string"), 9, "0").alias("filename"), host.cast("binary").alias("content"))
    return links.canonical_files(files).select("filename", "canonical")


@query(
    r"""with u as (select distinct unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) url from pages), p as (select url, list_last(string_split(string_split(url, '?')[1], '/')) path from u)
    select url, path, count(*) over (partition by path) > 1 collision from p where path not in (select 'p' || page_id from pages)"""
)
def link_manifest(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("lou"), "html")
    manifest = links.download_manifest(archive.attribute_links(pages, "href").select("url", "path"))
    return links.pending(manifest, pages.select(F.concat(F.lit("p"), F.col("lou").cast("string")).alias("path")))


@query(
    """with h as (select l_orderkey lou, 0 kind, 'c' || o_custkey author, l_returnflag || '#' || l_suppkey hit from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 30
      union all select o_orderkey, 1, case when o_orderstatus = 'O' then null else 'x' || o_custkey end, o_orderpriority from orders where o_totalprice > 100000),
    a as (select lou, string_agg(distinct hit, '|' order by hit) filter (kind = 0) t, string_agg(distinct hit, '|' order by hit) filter (kind = 1) i from h group by lou)
    select a.lou, (select author from h where h.lou = a.lou and coalesce(author, '') <> '' order by kind, author limit 1) author, coalesce(t, '') topic_hits, coalesce(i, '') ignore_hits from a"""
)
def floor_review(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    e = table(spark, sf_dir, "lineitem").where("l_quantity > 30").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    e = e.select(F.col("l_returnflag").alias("topic_id"), F.col("l_suppkey").alias("chosen_lou"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("author"), F.array("l_orderkey").alias("source_lous"))
    i = o.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("lou"), F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).alias("author"), F.col("o_orderpriority").alias("reason"))
    return links.floor_review(e, i)


# --- latest, numbers, roll-ups


@query(
    f"with r as (select *, row_number() over (partition by author_key, topic_id order by k desc, ord desc) n from ({POSTS})) select author_key, topic_id, k chosen_lou, ord, string_agg(lou, ',' order by lou) filter (topic_id <> 'view') over (partition by author_key, topic_id rows between unbounded preceding and unbounded following) lous from (select * from r) where false union all select author_key, topic_id, k, ord, case when topic_id = 'view' then '' else coalesce((select string_agg(s.lou, ',' order by s.lou) from r s where s.author_key = r.author_key and s.topic_id = r.topic_id and s.n > 1), '') end from r where n = 1 or topic_id = 'view'"
)
def latest_wins(spark, sf_dir):
    p = posts(spark, sf_dir).select("author_key", "topic_id", F.col("k").alias("chosen_lou"), "ord", F.array("lou").alias("source_lous"))
    kept, _ = latest.latest_wins(p, "topic_id = 'view'")
    return kept.select("author_key", "topic_id", "chosen_lou", "ord", F.array_join(F.col("superseded_lous").cast("array<string>"), ",").alias("lous"))


@query(
    f"with r as (select *, row_number() over w n, first(k) over w win from ({POSTS}) where topic_id <> 'view' window w as (partition by author_key, topic_id order by k desc, ord desc)) select author_key, topic_id, lou, win superseded_by_lou, '被同一作者的更新楼层 ' || win || ' 覆盖' ignore_reason, 'superseded' stage from r where n > 1"
)
def superseded(spark, sf_dir):
    p = posts(spark, sf_dir).select("author_key", "topic_id", F.col("k").alias("chosen_lou"), "ord", F.array("lou").alias("source_lous"))
    _, lost = latest.latest_wins(p, "topic_id = 'view'")
    return latest.superseded_rows(lost).select("author_key", "topic_id", "lou", "superseded_by_lou", "ignore_reason", "stage")


ENTRIES = f"select *, row_number() over (order by case topic_id when 'view' then 0 when 'click' then 1 when 'signup' then 2 when 'purchase' then 3 else 999 end, k, author_key, ord) entry_id from ({POSTS})"


def entries(spark, sf_dir) -> DataFrame:
    rows = posts(spark, sf_dir).withColumn("chosen_lou", F.col("k"))
    return numbering.entry_ids(rows, {t.id: n for n, t in enumerate(TOPICS)})


@query(f"select lou, topic_id, entry_id, row_number() over (partition by topic_id order by entry_id) topic_number from ({ENTRIES})")
def entry_numbers(spark, sf_dir):
    return views.topic_numbers(entries(spark, sf_dir)).select("lou", "topic_id", "entry_id", "topic_number")


@query(
    f"with a as (select author_key, count(*) entry_count, min(lou) first_lou, string_agg(distinct topic_id, ',' order by topic_id) topics, round(avg(k / 100.0::double), 4) confidence, bool_or(k > 95) review from ({POSTS}) group by 1) select *, row_number() over (order by first_lou, author_key) anchor_id from a"
)
def author_anchors(spark, sf_dir):
    e = entries(spark, sf_dir).withColumns({"source_lous": F.array("lou"), "confidence": F.col("k") / 100, "needs_manual_review": F.col("k") > 95})
    a = anchors.author_anchors(e)
    return a.select("author_key", "entry_count", "first_lou", F.array_join("topic_ids", ",").alias("topics"), "confidence", F.col("needs_manual_review").alias("review"), "anchor_id")


@query(f"with a as (select author_key, min(lou) f, count(*) n from ({POSTS}) group by 1), r as (select *, row_number() over (order by f, author_key) author_number from a) select lou, author_number, n > 1 maybe_duplicate from ({POSTS}) join r using (author_key)")
def author_numbers(spark, sf_dir):
    return numbering.author_numbers(posts(spark, sf_dir)).select("lou", "author_number", "maybe_duplicate")


@query("with t(topic_id) as (values ('view'), ('click'), ('signup'), ('purchase'), ('none')), c as (select event_type topic_id, count(*) n from events group by 1) select coalesce(t.topic_id, c.topic_id) topic_id, coalesce(n, 0) n from t full join c on t.topic_id = c.topic_id union all select 'all', count(*) from events")
def topic_options(spark, sf_dir):
    topics = anchors.topic_table(spark, (*TOPICS, Topic("none", "None", "none")))
    return anchors.topic_options(posts(spark, sf_dir), topics)


@query("select event_type topic_id, count(*) entries from events group by 1")
def topic_counts(spark, sf_dir):
    return anchors.topic_counts(posts(spark, sf_dir))


@query(
    "with l as (select distinct doc_id lou from labels union select -1), g as (select lou + 1 s, lead(lou, 1, (select max(doc_id) + 1 from documents)) over (order by lou) - 1 e from l) select s as start, e as \"end\", e - s + 1 as count from g where e >= s"
)
def missing_ranges(spark, sf_dir):
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    return gaps.missing_ranges(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("lou")), 0, last)


@query(
    "with l as (select distinct doc_id lou from labels), g as (select lou - lag(lou) over (order by lou) - 1 n from l) select (select count(*) from labels) post_count, (select min(lou) from l) min_lou, (select max(lou) from l) max_lou, coalesce(sum(n), 0)::bigint missing_count, count(*) filter (n > 0) range_count from g"
)
def raw_stats(spark, sf_dir):
    return gaps.raw_stats(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("lou")))


@query(f"select 'entry_review' as type, k lou, entry_id, 'k ' || k message from ({ENTRIES}) where k > 97 union all select 'runtime_warning', lou, null, 'value' from ({POSTS}) where k = 0")
def warning_details(spark, sf_dir):
    e = entries(spark, sf_dir).withColumns({"needs_manual_review": F.col("k") > 97, "note": F.concat(F.lit("k "), F.col("k").cast("string"))})
    return anchors.warning_details(e, posts(spark, sf_dir).where("k = 0").select("lou", F.lit("value").alias("message")))


@query(f"select lou, case when k % 3 = 0 then k || ',' || (k + 1) else k::varchar end lous from ({POSTS})")
def lou_lists(spark, sf_dir):
    """Floors as lists, single numbers and text, as replies give them."""
    from postloom.functions.scalars import lou_list

    k = F.col("k").cast("string")
    given = F.when(F.col("k") % 3 == 0, F.concat(F.lit("["), (F.col("k") + 1).cast("string"), F.lit(', "'), k, F.lit('", '), k, F.lit("]"))).when(F.col("k") % 3 == 1, k).otherwise(F.concat(F.lit(" "), k, F.lit(" ")))
    return posts(spark, sf_dir).select("lou", F.array_join(lou_list(given).cast("array<string>"), ",").alias("lous"))


# --- scored matches

SCORE = """case when h = '' then 0 when t = h then {same} when contains(t, h) then {holds} when length(t) >= 4 and contains(h, t) then 120 else 0 end"""


@query(
    rf"""with b as (select item_id, regexp_replace(lower(text), '[^0-9a-z一-鿿]+', '', 'g') h from benchmark), d as (select doc_id, regexp_replace(lower(text), '[^0-9a-z一-鿿]+', '', 'g') t from documents),
    s as (select item_id, doc_id, {SCORE.format(same=300, holds=240)} score from b cross join d), m as (select item_id, score, count(*) ties, min(doc_id) target from s where score > 0 group by 1, 2),
    x as (select item_id, max(score) score from m group by 1)
    select item_id asker, x.score, ties, case when ties = 1 then target end target from x join m using (item_id, score)"""
)
def weighted_target(spark, sf_dir):
    """Benchmark passages as hints, all documents as candidates. Odd entry ids ask, even ones are candidates."""
    b = table(spark, sf_dir, "benchmark").select((2 * F.col("item_id") + 1).alias("entry_id"), F.coalesce("text", F.lit("")).alias("hint"), F.lit(None).cast("string").alias("content"))
    d = table(spark, sf_dir, "documents").select((2 * F.col("doc_id")).alias("entry_id"), F.lit(None).cast("string").alias("hint"), F.col("text").alias("content"))
    entries = b.unionByName(d).withColumns({"topic_id": F.lit("passages"), "fields": F.array().cast("array<string>")})
    found = targets.weighted_targets(entries).where("score is not null")
    return found.select(F.shiftright("asker", 1).alias("asker"), "score", "ties", F.shiftright("target", 1).alias("target"))


@query(
    f"""with p as ({POSTS}), a as (select lou, k % 50 as reply, case when k % 3 = 0 then null else 'topic ' || (k % 10) end hint from p where k >= 50),
    o as (select lou target, k reply, 'topic' || (lou % 10) t from p where k < 50), j as (select a.lou, target, case when hint is null then null else regexp_replace(lower(hint), '[^0-9a-z]+', '', 'g') end h, t, count(*) over (partition by a.lou) n from a join o using (reply)),
    s as (select lou, target, case when t = h then 320 when contains(t, h) then 260 when length(t) >= 4 and contains(h, t) then 120 else 0 end score from j where h is not null and n > 1),
    b as (select lou, score, count(*) c, min(target) target from s where score > 0 group by 1, 2), x as (select lou, max(score) score from b group by 1)
    select lou, target, null::int score from j where h is null or n = 1 union all select lou, target, score from x join b using (lou, score) where c = 1"""
)
def reply_targets(spark, sf_dir):
    p = posts(spark, sf_dir)
    a = p.where("k >= 50").select("lou", (F.col("k") % 50).alias("reply_to_pid"), F.when(F.col("k") % 3 != 0, F.concat(F.lit("topic "), (F.col("k") % 10).cast("string"))).alias("hint"))
    o = p.where("k < 50").select(F.col("lou").alias("proposal_id"), "topic_id", F.array("k").alias("source_pids"), F.array().cast("array<string>").alias("fields"), F.concat(F.lit("topic"), (F.col("lou") % 10).cast("string")).alias("normalized_anchor_text"), F.lit(False).alias("is_weight"))
    return targets.reply_targets(a, o)


# --- whole plans


@query(
    f"with c as (select * from ({POSTS}) where {REASONS} = '') select row_number() over (order by lou, author_key, ord) entry_id, author_key, lou chosen_lou, 'unclassified' topic_id, md5(content) digest from c"
)
def no_model_entries(spark, sf_dir):
    out = tally.tally(spark, posts(spark, sf_dir), RULE, unescape=m.unescaped_basic)
    return out.entries.select("entry_id", "author_key", "chosen_lou", "topic_id", F.md5("normalized_anchor_text").alias("digest"))


def stub_classifier(prompt: str) -> str:
    """A stand-in for a remote model: the JSON number of each post decides its topic; multiples of ten are refused."""
    import json

    pack = json.loads(prompt)
    items, ignored = [], []
    for p in pack["posts"]:
        k = json.loads(p["content"])["k"]
        if k % 10 == 0:
            ignored.append({"lou": str(p["lou"]), "ignore_reason": "tenth"})
        else:
            items.append({"topic_id": ["view", "click", "signup"][k % 3], "normalized_anchor_text": f"k{k}", "source_lous": [str(p["lou"])], "chosen_lou": str(p["lou"]), "confidence": str(k / 100)})
    return "```json\n" + json.dumps({"items": items, "ignored_posts": ignored, "warnings": []}) + "\n```"


@query(
    f"""with c as (select *, case k % 3 when 0 then 'view' when 1 then 'click' else 'signup' end t from ({POSTS}) where {REASONS} = ''), k as (select *, row_number() over (partition by author_key, t order by lou desc) n from c where k % 10 <> 0),
    e as (select * from k where n = 1 or t = 'view')
    select row_number() over (order by case t when 'view' then 0 when 'click' then 1 else 2 end, lou, author_key) entry_id, author_key, lou chosen_lou, t topic_id, 'k' || k as text from e"""
)
def classified_entries(spark, sf_dir):
    out = tally.tally(spark, posts(spark, sf_dir), RULE, stub_classifier, unescape=m.unescaped_basic)
    return out.entries.select("entry_id", "author_key", "chosen_lou", "topic_id", F.col("normalized_anchor_text").alias("text"))


@query(
    f"""with c as (select *, case k % 3 when 0 then 'view' when 1 then 'click' else 'signup' end t from ({POSTS}) where {REASONS} = ''), k as (select *, row_number() over (partition by author_key, t order by lou desc) n from c where k % 10 <> 0)
    select lou, {REASONS} ignore_reason, 'deterministic' stage from ({POSTS}) where {REASONS} <> '' union all select lou, 'tenth', 'llm_author_pack' from c where k % 10 = 0
    union all select l.lou, '被同一作者的更新楼层 ' || w.lou || ' 覆盖', 'superseded' from k l join k w on l.author_key = w.author_key and l.t = w.t and w.n = 1 where l.n > 1 and l.t <> 'view'"""
)
def classified_ignored(spark, sf_dir):
    out = tally.tally(spark, posts(spark, sf_dir), RULE, stub_classifier, unescape=m.unescaped_basic)
    return out.ignored.select("lou", "ignore_reason", "stage")


@query(
    f"""with r as (select * from ({POSTS}) where lou > 100 and uid not in (3, 7, 11) and postdate <= '2024-01-20 12:00' and lou not in (500, 501, 777)), a as (select author_key, min(lou) f, count(*) n from r group by 1), b as (select *, row_number() over (order by f, author_key) author_number from a)
    select lou, author_number, n > 1 maybe_duplicate, trim(content) as text from r join b using (author_key)"""
)
def legacy_tally(spark, sf_dir):
    rows, _ = legacy.legacy_tally(posts(spark, sf_dir), RULE)
    return rows.select("lou", "author_number", "maybe_duplicate", "text")


@query("select doc_id // 200 part, count(*) floors, md5(string_agg(coalesce(text, ''), chr(10) order by doc_id)) digest from documents group by 1")
def html_parts(spark, sf_dir):
    from postloom.sources.sinks import html_buckets

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("lou"), F.coalesce("text", F.lit("")).alias("html"))
    n = docs.groupBy(F.floor(F.col("lou") / 200).alias("part")).agg(F.count("*").alias("floors"))
    return html_buckets(docs).join(n, "part").select("part", "floors", F.md5("html").alias("digest"))


@query(
    f"""with r as (select topic_id, entry_id n, '[b]#' || lou || '[/b] ' || coalesce(content, '') line from ({ENTRIES}) union all select 'ignored', lou, '[s]#' || lou || '[/s] late' from ({POSTS}) where k > 90),
    p as (select *, (row_number() over (partition by topic_id order by n) - 1) // 1000 part from r) select topic_id, part, md5(string_agg(line, chr(10) order by n)) digest from p group by 1, 2"""
)
def bbcode_export(spark, sf_dir):
    e = entries(spark, sf_dir).select("topic_id", "entry_id", F.array("lou").alias("source_lous"), "chosen_lou", F.col("content").alias("text"))
    i = posts(spark, sf_dir).where("k > 90").select("lou", F.format_string("作者 uid=%d 在忽略名单中；late", F.col("uid")).alias("ignore_reason"))
    return views.text_export(e, i).select("topic_id", "part", F.md5("body").alias("digest"))


@query(f"select topic_id, row_number() over (partition by topic_id order by k, entry_id) row_no, entry_id, k chosen_lou, username as name, '' as empty from ({ENTRIES})")
def sheet_rows(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("fields", F.create_map(F.lit("name"), F.col("username")))
    return views.sheet_rows(e, ["name", "empty"])


from postloom import queries_archive, queries_typed, queries_views  # noqa: E402, F401  register their queries here


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
