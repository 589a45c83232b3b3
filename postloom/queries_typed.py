"""Registered queries of typed JSON: values, fields that are lists, results read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import typed
from postloom.plans import payload, tally
from postloom.queries import POSTS, posts, query, table, talk

FORMS = """case lou % 9 when 0 then k::varchar when 1 then k || '.0' when 2 then '"' || k || '"' when 3 then '"' || k || '.0"' when 4 then 'true'
  when 5 then '[' || k || '.0, "' || (k + 1) || '", "x", 1.5, null, false]' when 6 then '{"b": {"c:d": [' || k || ', "e\\": f"]}, "a": null}' when 7 then 'null' else k || '.25' end"""


@query(
    f"""with t as (select lou, k, lou % 9 r from ({POSTS}))
    select lou, case when r in (0, 1, 2) then k end n, case r when 0 then k when 1 then k when 2 then k when 3 then k when 8 then k + 0.25 end::double x,
      case when r in (0, 1, 2) then k::varchar when r = 5 then k || ',' || (k + 1) else '' end ns, case r when 2 then k::varchar when 3 then k || '.0' when 5 then (k + 1) || '|x' else '' end texts,
      case r when 0 then k::varchar when 1 then k::varchar when 2 then k::varchar when 3 then k || '.0' when 4 then 'true' when 5 then k || chr(10) || (k + 1) || chr(10) || 'x' || chr(10) || '1.5' || chr(10) || 'false'
        when 6 then '{{"a": null,"b": {{"c:d": [' || k || ',"e\\": f"]}}}}' when 7 then '' else k || '.25' end as cell,
      case when r = 7 or (r in (0, 1) and k = 0) then false else true end held from t"""
)
def typed_values(spark, sf_dir):
    """Whole floats are whole numbers, "12.0" and true are none; lists and objects keep their values."""
    v = F.try_parse_json(F.expr(FORMS.replace("k::varchar", "cast(k as string)").replace("\\", "\\\\")))
    rows = posts(spark, sf_dir).select("lou", v.alias("v"))
    v = F.col("v")
    return rows.select("lou", typed.as_int(v).alias("n"), typed.as_float(v).alias("x"), F.array_join(typed.as_ints(v).cast("array<string>"), ",").alias("ns"), F.array_join(typed.as_texts(v), "|").alias("texts"), typed.cell(v).alias("cell"), typed.holds(v).alias("held"))


@query(
    """select conv_id, turn, role || '甲、' || role || conv_id || case when turn % 2 = 0 then '' else '、' || role || turn || '号' end names from conversations"""
)
def list_fields(spark, sf_dir):
    """Names from a field that is a list or one text, then from the submission's own text, each once."""
    listed = F.when(F.col("turn") % 2 == 0, F.to_json(F.array(F.concat("role", F.lit("甲")), F.concat("role", F.col("conv_id").cast("string"))))).otherwise(F.concat(F.lit('"'), "role", F.lit('甲"')))
    more = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit("甲"))).otherwise(F.concat_ws("、", F.concat("role", F.col("conv_id").cast("string")), F.concat("role", F.col("turn").cast("string"), F.lit("号"))))
    key = F.struct(F.col("conv_id").cast("long").alias("ord"), F.col("turn").cast("long").alias("item_no"))
    rows = talk(spark, sf_dir).select("conv_id", "turn", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("author_key"), F.lit("theme4_carriage_name").alias("topic_id"), F.array(F.col("turn").cast("long")).alias("source_lous"), more.alias("normalized_anchor_text"), F.create_map(F.lit("名字"), listed, F.lit("数"), F.lit("12")).alias("fields"), key.alias("ord"))
    texts = rows.select("author_key", F.explode("source_lous").alias("lou"), F.lit("no label").alias("content")).limit(0)
    return tally.named(rows, texts).select("conv_id", "turn", F.col("normalized_anchor_text").alias("names"))


def results(spark, sf_dir):
    """A result for each customer: orders as posts of anchors, some anchors with entries, some results with a list of entries."""
    o = table(spark, sf_dir, "orders")
    text = F.col("o_orderkey").cast("string")
    post = F.concat(F.lit('{"lou": '), text, F.lit('.0, "pid": "'), text, F.lit('", "content": "'), F.col("o_orderpriority"), F.lit('", "confidence": 0.5}'))
    entry = F.concat(F.lit('{"id": '), text, F.lit(', "topic_id": "qa", "lou": '), text, F.lit(', "source_lous": ['), text, F.lit(', "'), text, F.lit('"], "fields": {"p": ["'), F.col("o_orderstatus"), F.lit('"]}}'))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", c.alias("j")))), lambda x: x["j"]), ",")
    grouped = o.groupBy("o_custkey", (F.col("o_orderkey") % 2).alias("half")).agg(in_order(post).alias("posts"), in_order(entry).alias("entries"))
    anchor = F.concat(F.lit('{"author": {"uid": '), F.col("o_custkey").cast("string"), F.lit("}, "), F.when(F.col("half") == 0, F.concat(F.lit('"entries": ['), "entries", F.lit("], "))).otherwise('"entries": [], '), F.lit('"posts": ['), "posts", F.lit("]}"))
    held = grouped.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("half", anchor.alias("j"), "entries"))), lambda x: x["j"]), ",").alias("anchors"), F.min(F.struct("half", "entries"))["entries"].alias("entries"))
    listed = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit('"entries": ['), "entries", F.lit("], "))).otherwise("")
    return held.select("o_custkey", F.concat(F.lit("{"), listed, F.lit('"anchors": ['), "anchors", F.lit("]}")).alias("payload"))


@query(
    """with o as (select o_custkey, o_orderkey k, o_orderkey % 2 half, o_orderpriority c, o_orderstatus s, min(o_orderkey % 2) over (partition by o_custkey) least from orders),
    e as (select *, row_number() over (partition by o_custkey order by half, k) - 1 place from o where o_custkey % 3 <> 0 union all select *, row_number() over (partition by o_custkey order by k) - 1 from o where o_custkey % 3 = 0 and half = least)
    select o_custkey, place::int place, case when o_custkey % 3 = 0 or half = 0 then k else place + 1 end entry_id, case when o_custkey % 3 = 0 or half = 0 then 'qa' else 'unclassified' end topic_id, k lou,
      case when o_custkey % 3 = 0 or half = 0 then null else 'https://ngabbs.com/read.php?pid=' || k || '&opt=128' end url, case when o_custkey % 3 = 0 or half = 0 then null else c end as content, k::varchar lous,
      case when o_custkey % 3 = 0 or half = 0 then '["' || s || '"]' end field, case when o_custkey % 3 = 0 or half = 0 then null else o_custkey::varchar end uid from e"""
)
def result_entries(spark, sf_dir):
    """Entries of results: listed ones, those of anchors, and those rebuilt from an anchor's posts."""
    e = payload.entries_of(results(spark, sf_dir), "o_custkey")
    return e.select("o_custkey", "place", "entry_id", "topic_id", "lou", "url", "content", F.array_join(F.col("source_lous").cast("array<string>"), ",").alias("lous"), F.try_element_at("fields", F.lit("p")).alias("field"), "uid")
