"""Cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from postloom.functions import markup as m
from postloom.functions import matching as mt
from postloom.functions import scalars as sc
from postloom.operators.targets import weight_score
from postloom.rules import ALIASES, TOPICS, Rule


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (sc.to_int, "3.0", None),
        (sc.to_int, " 12 ", 12),
        (sc.to_int, "x", None),
        (lambda c: sc.page_of(c.cast("long")), "0", 1),
        (lambda c: sc.page_of(c.cast("long")), "20", 2),
        (lambda c: sc.page_of(c.cast("long")), "21552", 1078),
        (lambda c: sc.confidence(c.try_cast("double")), "1.7", 1.0),
        (lambda c: sc.confidence(c.try_cast("double")), "x", None),
        (m.clean_post, "a<br/>b", "a\nb"),
        (m.clean_post, "[img]u[/img]x", "x"),
        (m.clean_post, "&amp;lt;", "<"),
        (m.clean_post, "[1][hello]", "[1]"),
        (m.clean_post, "a \n\n\n\nb", "a\n\nb"),
        (m.clean_post, "x&copy;[quote][pid=5,6,7]Reply[/pid] hi[/quote]", "x©"),
        (m.clean_post, None, ""),
        (m.clean_legacy, "[1]x&amp;&quot;", 'x&amp;"'),
        (m.clean_legacy, "a<BR>b", "ab"),
        (m.bbcode_to_html, "[b]x[/b]", "<strong>x</strong>"),
        (m.bbcode_to_html, "[quote][quote]a[/quote][/quote]", "<blockquote><blockquote>a</blockquote></blockquote>"),
        (lambda c: m.truncated(c, 3), "abcdef", "abc\n...[已截断]"),
        (lambda c: m.truncated(c, 0), "abc", "abc"),
        (mt.match_form, "A b-中！", "ab中"),
        (lambda c: mt.topic_id(c, ALIASES), "主题1", "theme1_travel"),
        (lambda c: mt.topic_id(c, ALIASES), "QA", "qa"),
        (lambda c: mt.topic_id(c, ALIASES), "Theme 1", "theme_1"),
        (lambda c: mt.topic_id(c, ALIASES), " ", "unclassified"),
        (sc.json_object, '```json\n{"a":1}\n```', '{"a":1}'),
        (sc.json_object, 't {"a":1} z', '{"a":1}'),
        (sc.json_object, "[1]", None),
        (mt.weight_hint, "加权一下", "一下"),
        (mt.weight_hint, "安价：加权 “甲”", "甲"),
        (mt.weight_hint, "别的", None),
        (mt.is_weight_only, "加权一下！", True),
        (mt.proxy_reason, "帮 别人安价", mt.PROXY_REASONS[1]),
        (mt.placeholder_topics, "主题1：（请输入文本） 问答: 请输入文本", ["qa", "theme1_travel"]),
        (mt.clean_name, "马车名字：名称：“甲”", "甲"),
        (mt.clean_name, "主题4", None),
        (mt.clean_name, "请输入文本", None),
        (mt.split_names, "甲、乙，甲", ["甲", "乙"]),
        (mt.names_in, "马车名字：甲、乙\n再来一个：\n丙\n别的：x", ["甲", "乙", "丙"]),
        (m.export_reason, "作者 uid=5 在忽略名单中；清洗后内容为空", "清洗后内容为空"),
        (m.speaker, "小祥：你好", "小祥"),
        (m.speaker, "ABC: x", None),
        (m.file_name, "http://a/b/c.png?x=1", "c.png"),
    ],
)
def test_value(spark, f, text, want):
    assert value(spark, text, f) == want


@pytest.mark.parametrize(
    ("hint", "fields", "texts", "want"),
    [
        ("abc", ["zabcz"], {"content": "abc"}, 300),
        ("xabcdx", ["abcd"], {}, 260),
        ("xabcdx", [], {"content": "abcd"}, 120),
        ("xabcx", ["abc"], {}, 0),
        ("abc", ["ABC"], {"content": "zz"}, 400),
        ("", ["a"], {}, 0),
    ],
)
def test_score(spark, hint, fields, texts, want):
    df = spark.createDataFrame([(hint, fields)], "h string, f array<string>")
    assert df.select(weight_score(F.col("h"), F.col("f"), {k: F.lit(v) for k, v in texts.items()}).alias("s")).first()["s"] == want


def test_rule_overrides():
    rule = Rule(5, ignore_author_user=(1,)).overridden(start_lou=7, ignore_author_user=[2, 1], keyword=None)
    assert (rule.start_lou, rule.ignore_author_user, rule.keyword) == (7, (1, 2), None)
    assert [t.id for t in Rule(1, topics=TOPICS[2:3]).with_default_topics().topics][0] == "theme2_guest"


def test_texts_without_markup_are_only_stripped(spark):
    odd = [None, "", " \t", "plain", " a b ", "a\r\nb", "a \n\n\n\n b", "a&lt;b", "a&amp;amp;lt;", "<br>x", "[b]x[/b]", "a\x0bb\x85", "]>;", "a  \tb ", "[quote][pid=1]Reply[/pid]x[/quote]y", '{"k": 1}']
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    rows = df.select(m.clean_post(F.col("t")).alias("whole"), m.cleaned_post(F.col("t")).alias("short"), m.reply_context(F.col("t"))["has_reply_quote"].alias("quoted"), m.reply_context(F.col("t"))["reply_quote_count"].alias("n")).collect()
    assert [r.whole for r in rows] == [r.short for r in rows]
    assert [r.n for r in rows] == [int("Reply" in (t or "")) for t in odd] and [r.quoted for r in rows] == [r.n > 0 for r in rows]
