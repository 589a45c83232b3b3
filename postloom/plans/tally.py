"""The submission tally: posts to numbered entries, roll-ups, refusals, warnings and statistics."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions.markup import cleaned_post, compact, reply_context, strip, truncated, unescaped_twice
from postloom.functions.matching import asks_weight, inline_names, is_weight_only, match_form, names_in, placeholder_topics, proxy_reason, scoped_reasons, split_names, topic_id, weight_hint
from postloom.functions.scalars import confidence, distinct_by, json_object, to_int, without_prefixes
from postloom.functions.typed import as_float, as_int, as_ints, as_text, elements, field_texts, first_held, holds, is_nothing, kind, member, members, plain
from postloom.operators.anchors import author_anchors, topic_counts, topic_names, topic_table, warning_details
from postloom.operators.calls import Limits, called
from postloom.operators.filters import qa_without_marker, split_posts
from postloom.operators.gaps import missing_ranges, raw_stats
from postloom.operators.latest import latest_wins, superseded_rows
from postloom.operators.links import item_sources, new_pairs, proxies_recovered, uncovered
from postloom.operators.numbering import entry_ids
from postloom.operators.packs import author_packs, reply_context_posts
from postloom.operators.targets import reply_failures, reply_targets, weighted_targets
from postloom.rules import ALIASES, TOPICS, Rule, Topic
from postloom.tables import keep, shared_folder

PROPOSAL = ("author_key", "topic_id", "chosen_lou", "source_lous", "normalized_anchor_text", "fields", "confidence", "needs_manual_review", "note", "ord")
#: Stages and reasons of refused posts.
MODEL, NOT_FOR_QA, BLANK = "llm_author_pack", "reply_quote_filter", "placeholder_topic_filter"
MODEL_REASON, NOT_FOR_QA_REASON = "模型判定不是有效安价", "带 Reply 引用且正文缺少明确 Q&A 标记，按聊天处理"
BLANK_REASON, UNCOVERED_REASON = "无有效安价内容，仅为占位符", "模型未将该楼归入任何有效条目"
#: Warnings about several names in one post, which no longer hold once all of them are kept.
NAMES_OF_FLOOR = r"候选楼(\d+)包含两个马车名字安价，按规则只保留第一个；第二个未计入。"
NAMES_OF_ONE = ("一楼内出现两个名字，只保留第一个", "第二个")
#: Lies below the numbers of all other proposals that are no item of a reply.
RECOVERED = -(1 << 40)


@dataclass
class Tally:
    entries: DataFrame
    anchors: DataFrame
    ignored: DataFrame
    warnings: DataFrame
    topic_counts: DataFrame
    missing: DataFrame
    stats: DataFrame
    counts: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {name: df for name, df in vars(self).items() if df is not None}


def holds_object(reply: str | None) -> bool:
    """Whether the reply, or what stands from its first brace to its last, is a JSON object."""
    text = (reply or "").strip()
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            if isinstance(json.loads(part), dict):
                return True
        except ValueError:
            continue
    return False


def proposal_id(ord: Column, item_no: Column) -> Column:
    """Tells proposals apart and orders them: by post, then by item; those that are no item of a reply have negative numbers."""
    return F.struct(ord.cast("long").alias("ord"), item_no.cast("long").alias("item_no"))


def pack_prompt(rule: Rule) -> Column:
    """What a language model is asked about a pack: the task, notes on the pack's floors, topics, the form of the answer, and the posts, each cut at the rule's limit."""
    topics = json.dumps([{"id": t.id, "name": t.name, "description": t.description, "allow_multiple_per_author": t.allow_multiple_per_author, "end_time": t.end_time} for t in rule.topics], ensure_ascii=False)
    ids = " | ".join([*(t.id for t in rule.topics), "unclassified"])
    item = {"topic_id": ids, "normalized_anchor_text": "该条目的正文", "fields": {"字段名": "值"}, "source_lous": [1], "chosen_lou": 1, "confidence": 0.0, "needs_manual_review": False, "note": "可选"}
    form = json.dumps({"items": [item], "ignored_posts": [{"lou": 1, "source_lous": [1], "ignore_reason": "原因", "topic_id": "可选", "superseded_by_lou": "可选"}], "warnings": ["可选"]}, ensure_ascii=False)
    task = "\n".join(
        [
            "把一位作者的全部候选楼整体归类为安价条目。",
            "- 每个主题单独成条；作者没有提交的主题不要补写。",
            "- 同一作者重复提交同一主题时只留最新一楼，旧楼写入 ignored_posts 并注明被哪一楼覆盖；允许多条的主题除外。",
            "- 代发的安价不覆盖作者自己的安价，两者都保留。",
            "- 一楼里的多个名字合成一条，用顿号连接。",
            "- context_posts 只供理解回复关系，不得写入结果；回复里的“加权”以当前楼成条，正文写成“加权：<内容>”。",
            "- 提问类主题只收明确的提问；引用回复里的闲聊、追问不算。",
            "- 聊天、顶帖、无效内容写入 ignored_posts；像安价但无法归类的用 unclassified 并要求人工复核。",
            "- 不要返回作者标识。",
        ]
    )
    notes = F.array(*[F.struct(F.lit(lou).cast("long").alias("lou"), F.lit(text).alias("text")) for lou, text in rule.floor_notes]) if rule.floor_notes else F.array().cast("array<struct<lou:bigint,text:string>>")
    here = F.filter(notes, lambda n: F.exists(F.col("posts"), lambda p: p["lou"] == n["lou"]))
    special = F.when(F.size(here) > 0, F.concat(F.lit("特定楼层：\n"), F.array_join(F.transform(here, lambda n: F.concat(F.lit("- "), n["text"])), "\n"), F.lit("\n\n"))).otherwise("")
    limit = rule.post_char_limit
    cut = lambda p: p.withField("content", truncated(p["content"], limit)).withField("content_truncated", (F.length(p["content"]) > limit) if limit > 0 else F.lit(False))
    shown = F.to_json(F.struct(F.transform("posts", cut).alias("posts"), F.transform("context_posts", lambda p: cut(p).withField("context_only", F.lit(True))).alias("context_posts")))
    return F.concat(F.lit(task + "\n\n"), special, F.lit(f"主题：\n{topics}\n\n只返回一个 JSON 对象，形如：\n{form}\n\n候选楼：\n"), shown)


def classified(packs: DataFrame, classifier: Callable[[str], str], retries: int = 2, prompt: Column | None = None, limits: Limits | None = None) -> DataFrame:
    """(author_key, reply): the classifier's answer to each pack as JSON text; null where it failed. It is asked again while the answer holds no JSON object.

    It is asked `prompt` (see pack_prompt), or the pack itself as JSON. A failure, or an answer that takes
    longer than the limits allow, counts for its own pack alone. So many packs are asked at a time in each task
    as the limits say.
    """

    def ask(text: str) -> str | None:
        reply = None
        for attempt in range(retries + 1):
            reply = classifier(text if not attempt else text + "\n只输出一个 JSON 对象。")
            if holds_object(reply):
                break
        return reply

    shown = F.to_json(F.struct("author_key", "posts", "context_posts")) if prompt is None else prompt
    asked = called(packs.select("author_key", shown.alias("prompt")), "prompt", ask, limits or Limits(seconds=180 * (retries + 1)), "reply")
    return asked.select("author_key", "reply")


def unclassified(candidates: DataFrame, note: str = "") -> DataFrame:
    """Without a model, every post is a submission that somebody has to look at."""
    return candidates.select(
        "author_key",
        F.lit("unclassified").alias("topic_id"),
        F.col("lou").alias("chosen_lou"),
        F.array("lou").alias("source_lous"),
        F.col("content").alias("normalized_anchor_text"),
        F.create_map().cast("map<string,string>").alias("fields"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(True).alias("needs_manual_review"),
        F.lit(note).alias("note"),
        proposal_id(F.col("ord"), F.lit(-1)).alias("ord"),
    )


def objects_of(parsed: DataFrame, name: str, number: str) -> DataFrame:
    """(author_key, number, i): the objects in a reply's list of that name; other values in it are left out. parsed: author_key, r (VARIANT)."""
    listed = parsed.select("author_key", F.posexplode(elements(member(F.col("r"), name))).alias(number, "i"))
    return listed.where(kind(F.col("i")) == "OBJECT")


def refusals_of(parsed: DataFrame, candidates: DataFrame, topics: Sequence[Topic]) -> tuple[DataFrame, DataFrame]:
    """(rows, stubs) of the floors that replies refuse: a row for each floor of the author's own, and one for each refusal that names none of them."""
    said = objects_of(parsed, "ignored_posts", "n")
    of = lambda name: member(F.col("i"), name)
    topic = F.when(holds(of("topic_id")), topic_id(plain(of("topic_id")), ALIASES))
    reason = F.when(strip(F.coalesce(as_text(of("ignore_reason")), F.lit(""))) != "", as_text(of("ignore_reason"))).otherwise(MODEL_REASON)
    said = said.select("author_key", "n", as_int(of("lou")).alias("named"), as_ints(of("source_lous")).alias("lous"), topic.alias("topic_id"), reason.alias("reason"), as_int(of("superseded_by_lou")).alias("superseded_by_lou"))
    said = said.withColumns({"ignore_reason": F.when(F.col("topic_id").isNull(), F.col("reason")).otherwise(scoped_reasons(F.col("reason"), F.col("topic_id"), topics)), "stage": F.lit(MODEL), "ord": F.col("n").cast("long")})
    all_lous = F.array_union("lous", F.when(F.col("named").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("named")))
    found = said.withColumn("lou", F.explode(all_lous)).join(candidates.select("author_key", "lou"), ["author_key", "lou"])
    stubs = said.join(found.select("author_key", "n").distinct(), ["author_key", "n"], "left_anti").withColumn("lou", F.col("named"))
    columns = ["author_key", "lou", "topic_id", "ignore_reason", "stage", "superseded_by_lou", "ord"]
    return found.select(*columns), stubs.select(*columns)


def normalised(candidates: DataFrame, replies: DataFrame, topics: Sequence[Topic] = TOPICS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals, refused, warnings) from the classifier's replies."""
    parsed = replies.select("author_key", F.try_parse_json(json_object(F.col("reply"))).alias("r"))
    failed = parsed.where("r is null").select("author_key")
    of = lambda name: member(F.col("i"), name)
    chosen = F.coalesce(as_int(of("chosen_lou")), as_int(of("lou")))
    items = objects_of(parsed, "items", "item_no").select(
        "author_key",
        "item_no",
        topic_id(plain(first_held(of("topic_id"), of("topic"), of("topic_name"))), ALIASES).alias("topic_id"),
        as_text(first_held(of("normalized_anchor_text"), of("content"), of("text"))).alias("given"),
        F.coalesce(F.transform_values(members(of("fields")), lambda _, v: F.to_json(v)), F.create_map().cast("map<string,string>")).alias("fields"),
        F.array_union(as_ints(of("source_lous")), F.when(chosen.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(chosen))).alias("source_lous"),
        chosen.alias("chosen_lou"),
        confidence(as_float(of("confidence"))).alias("confidence"),
        holds(of("needs_manual_review")).alias("review"),
        F.coalesce(as_text(first_held(of("note"), of("classification_note"))), F.lit("")).alias("note"),
    )
    items = item_sources(items, candidates)
    post = candidates.select("author_key", F.col("lou").alias("chosen_lou"), F.col("content").alias("post"), F.col("reply.has_reply_quote").alias("quoted"), "ord")
    items = items.join(post, ["author_key", "chosen_lou"])
    items = items.withColumn("normalized_anchor_text", compact(F.when(strip(F.coalesce("given", F.lit(""))) != "", F.col("given")).otherwise(F.col("post"))))
    refused_qa = qa_without_marker(F.col("topic_id"), F.col("quoted"), F.coalesce("normalized_anchor_text", F.lit("")), F.col("post"))
    proposals = items.where(~refused_qa).withColumn("needs_manual_review", F.col("review") | F.col("sources_missing") | (F.col("topic_id") == "unclassified"))
    proposals = proposals.withColumn("ord", proposal_id(F.col("ord"), F.col("item_no"))).select(*PROPOSAL)
    by_filter = items.where(refused_qa).select("author_key", F.col("chosen_lou").alias("lou"), "topic_id", F.lit(NOT_FOR_QA_REASON).alias("ignore_reason"), F.lit(NOT_FOR_QA).alias("stage"), F.lit(None).cast("long").alias("superseded_by_lou"), "ord")
    said, stubs = refusals_of(parsed, candidates, topics)
    blank = candidates.select("author_key", "lou", F.explode(placeholder_topics(F.col("content"))).alias("topic_id"), F.lit(BLANK).alias("stage"), F.lit(None).cast("long").alias("superseded_by_lou"), "ord")
    blank = blank.withColumn("ignore_reason", scoped_reasons(F.lit(BLANK_REASON), F.col("topic_id"), topics))
    pairs = proposals.select(F.explode("source_lous").alias("lou"), "topic_id").unionByName(said.select("lou", "topic_id")).unionByName(by_filter.select("lou", "topic_id"))
    refused = said.unionByName(by_filter).unionByName(new_pairs(blank, pairs))
    proxied, refused = proxies_recovered(refused, candidates, proxy_reason)
    back = candidates.select("author_key", "lou", "content", F.col("ord").alias("post")).join(proxied.select("author_key", "lou", "topic_id", "proxy_reason", "ord"), ["author_key", "lou"])
    back = back.select("author_key", "topic_id", F.col("lou").alias("chosen_lou"), F.array("lou").alias("source_lous"), F.col("content").alias("normalized_anchor_text"), F.create_map().cast("map<string,string>").alias("fields"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("needs_manual_review"), F.col("proxy_reason").alias("note"), proposal_id(F.col("post"), -2 - F.col("ord")).alias("ord"))
    proposals = proposals.unionByName(back).unionByName(unclassified(candidates.join(failed, "author_key", "left_semi"), "分类失败"))
    used = proposals.select(F.explode("source_lous").alias("lou"))
    bare = uncovered(candidates.select("author_key", "lou", "ord"), used, said)
    rest = bare.select("author_key", "lou", F.lit(None).cast("string").alias("topic_id"), F.lit(UNCOVERED_REASON).alias("ignore_reason"), F.lit(MODEL).alias("stage"), F.lit(None).cast("long").alias("superseded_by_lou"), "ord")
    told = parsed.select("author_key", F.explode(F.transform(elements(member(F.col("r"), "warnings")), plain)).alias("message")).withColumn("message", strip(F.col("message"))).where("message <> ''")
    wrong = [parsed.where(~is_nothing(F.col("r"))).where(kind(member(F.col("r"), name)) != "ARRAY").select("author_key", F.concat("author_key", F.lit(f" 的模型返回 {name} 不是数组，已忽略该字段")).alias("message")) for name in ("items", "ignored_posts")]
    warnings = told.unionByName(wrong[0]).unionByName(wrong[1])
    return proposals, refused.unionByName(stubs).unionByName(rest), warnings


def warnings_that_hold(warnings: DataFrame, names: DataFrame) -> DataFrame:
    """(lou, message) without those that say that only the first of several names was kept, where all were. warnings: author_key, message; names: proposals of names."""
    several = names.where(F.contains("normalized_anchor_text", F.lit("、"))).select("author_key", F.explode("source_lous").alias("about")).distinct()
    about = to_int(F.regexp_extract("message", NAMES_OF_FLOOR, 1))
    left = warnings.withColumn("about", about).join(several, ["author_key", "about"], "left_anti")
    of_one = F.contains("message", F.lit(NAMES_OF_ONE[0])) & F.contains("message", F.lit(NAMES_OF_ONE[1]))
    gone = several.select("author_key").distinct().withColumn("_several", F.lit(True))
    left = left.join(gone, "author_key", "left").where(~(of_one & F.coalesce("_several", F.lit(False))))
    return left.select(F.lit(None).cast("long").alias("lou"), "message")


def named(proposals: DataFrame, posts: DataFrame, topic: str = "theme4_carriage_name", unescape=lambda c: c) -> DataFrame:
    """Submissions of names: all names in their fields, text and posts, each once, joined. Others stay as they are.

    posts: author_key, lou, content. A name that another one is but for a bracketed addition is left out.
    """
    ours = proposals.where(F.col("topic_id") == topic)
    texts = ours.select("ord", "author_key", F.explode("source_lous").alias("lou")).join(posts.select("author_key", "lou", "content"), ["author_key", "lou"])
    texts = texts.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("lou", "content"))).alias("_posts"))
    given = F.flatten(F.transform(field_texts(F.col("fields")), lambda v: split_names(v, unescape)))
    here = inline_names(F.coalesce("normalized_anchor_text", F.lit("")), unescape)
    there = F.flatten(F.transform(F.coalesce(F.col("_posts.content"), F.array().cast("array<string>")), lambda v: names_in(v, unescape)))
    names = without_prefixes(distinct_by(F.concat(given, here, there), match_form))
    joined = F.nullif(F.array_join(names, "、"), F.lit(""))
    ours = ours.join(texts, "ord", "left").withColumn("normalized_anchor_text", F.coalesce(joined, "normalized_anchor_text")).select(*proposals.columns)
    return proposals.where(F.coalesce(F.col("topic_id") != topic, F.lit(True))).unionByName(ours)


def _offers(proposals: DataFrame, candidates: DataFrame) -> DataFrame:
    """Proposals with the post ids that a reply may name."""
    rows = proposals.select(F.col("ord").alias("proposal_id"), "topic_id", "fields", "normalized_anchor_text", F.col("chosen_lou").alias("target_lou"), F.explode("source_lous").alias("lou")).join(candidates.select("lou", "pid"), "lou")
    same = lambda c: F.min(c).alias(c)  # noqa: E731  the same in all rows of a proposal
    rows = rows.groupBy("proposal_id").agg(same("topic_id"), F.min(field_texts(F.col("fields"))).alias("fields"), same("normalized_anchor_text"), same("target_lou"), F.collect_list("pid").alias("source_pids"))
    return rows.withColumn("is_weight", F.coalesce(weight_hint(F.col("normalized_anchor_text")).isNotNull() | is_weight_only(F.col("normalized_anchor_text")), F.lit(False)))


def weight_text(topic: Column, match_text: Column, meant: Column, content: Column) -> Column:
    """What a reply that adds weight says: the target's names where it is one of names, else the text that matched, else the target's, else its own."""
    blank = lambda c: F.nullif(compact(c), F.lit(""))
    hint = F.when(topic == "theme4_carriage_name", F.coalesce(blank(meant), blank(match_text))).otherwise(F.coalesce(blank(match_text), blank(meant)))
    one_line = F.nullif(strip(F.regexp_replace(hint, r"(?U)\n|\s{2,}", " ")), F.lit(""))
    return F.coalesce(F.concat(F.lit("加权："), one_line), blank(content), F.lit("加权"))


def _askers(asks: DataFrame) -> DataFrame:
    return asks.select(F.col("key").alias("lou"), "reply_to_pid", "hint", "preview")


def _weights(asks: DataFrame, offers: DataFrame) -> DataFrame:
    """Submissions that replies stand for, one a target, in order of the targets. asks: key (the floor asked for), lou (the reply's), author_key, hint, preview, content, reply_to_pid, ord, confidence, source_lous."""
    found = reply_targets(_askers(asks), offers).withColumnRenamed("lou", "key")
    offered = offers.select(F.col("proposal_id").alias("target"), "topic_id", F.col("normalized_anchor_text").alias("meant"), "target_lou")
    rows = asks.join(found.select("key", "target", "match_text").join(offered, "target"), "key")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("target_lou", "topic_id", "target"))
    pid = F.col("reply_to_pid").cast("string")
    every = F.when(F.col("hint").isNull(), F.concat(F.lit("Reply 引用 pid="), pid, F.lit("，无显式目标，按被回复楼全部主题加权处理")))
    return rows.select(
        "key",
        "author_key",
        "topic_id",
        F.col("lou").alias("chosen_lou"),
        F.array_sort(F.array_union("source_lous", F.array("lou"))).alias("source_lous"),
        weight_text(F.col("topic_id"), F.col("match_text"), F.col("meant"), F.col("content")).alias("normalized_anchor_text"),
        F.create_map().cast("map<string,string>").alias("fields"),
        "confidence",
        F.lit(False).alias("needs_manual_review"),
        F.coalesce(every, F.concat(F.lit("Reply 引用 pid="), pid, F.lit("，按加权处理"))).alias("note"),
        proposal_id(F.col("ord"), F.lit(RECOVERED) + rank).alias("ord"),
    )


def recovered_weights(proposals: DataFrame, refused: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals, refused, warnings): replies that add weight become submissions to the topics of what they reply to.

    First those that the classifier made submissions of: all of a floor are replaced by what
    the first one's earliest post points to. Then those that were refused, unless the floor
    has a submission to the topic. Where no target is found, rows stay as they are and a
    warning says why.
    """
    spark = proposals.sparkSession
    folder = shared_folder(spark)
    posts = candidates.where(F.coalesce(F.col("asks") | F.col("weight_only"), F.lit(False)))
    if posts.isEmpty():
        return proposals.select(*PROPOSAL), refused, spark.createDataFrame([], "lou long, message string")
    posts = posts.select("author_key", "lou", "hint", "content", F.col("reply.reply_to_pid").alias("reply_to_pid"), F.col("reply.quoted_preview").alias("preview"), "ord", "weight_only")
    named_posts = posts.where("reply_to_pid is not null")
    offers = keep(_offers(proposals, candidates), f"{folder}/offers")
    made = proposals.select("author_key", F.col("chosen_lou").alias("key"), F.array_min("source_lous").alias("lou"), F.col("ord").alias("proposal"), "confidence", "source_lous")
    asked = made.join(named_posts, ["author_key", "lou"])
    first = asked.groupBy("author_key", "key").agg(F.min("proposal").alias("proposal"))
    asked = keep(asked.join(first, ["author_key", "key", "proposal"]), f"{folder}/asked")
    fresh = keep(_weights(asked, offers), f"{folder}/fresh")
    proposals = proposals.join(fresh.select(F.col("key").alias("chosen_lou")).distinct(), "chosen_lou", "left_anti").select(*PROPOSAL).unionByName(fresh.select(*PROPOSAL))
    asks = refused.select("author_key", "lou").distinct().join(posts.where("reply_to_pid is not null or weight_only"), ["author_key", "lou"])
    asks = keep(asks.withColumns({"key": F.col("lou"), "confidence": F.lit(None).cast("double"), "source_lous": F.array().cast("array<bigint>")}), f"{folder}/asks")
    back = keep(_weights(asks.where("reply_to_pid is not null"), offers), f"{folder}/back")
    there = proposals.select(F.col("chosen_lou").alias("lou"), "topic_id")
    added = new_pairs(back.withColumn("lou", F.col("chosen_lou")), there)
    said = lambda rows, what: reply_failures(_askers(rows), offers).select("lou", F.concat(F.format_string("楼层 %d 的 Reply 加权", F.col("lou")), F.lit(what), F.col("reason")).alias("message"))
    warnings = said(asked, "未能从模型条目规范化：").unionByName(said(asks, "未能恢复："))
    return proposals.unionByName(added.select(*PROPOSAL)), refused.join(back.select("author_key", F.col("key").alias("lou")).distinct(), ["author_key", "lou"], "left_anti"), warnings


def run_counts(out: Tally, candidates: DataFrame) -> DataFrame:
    """One row: candidates, entries, authors, refused rows, those that a newer submission superseded, and whether somebody has to look."""
    superseded = (F.col("stage") == "superseded") | (F.coalesce("superseded_by_lou", F.lit(0)) != 0)
    parts = out.entries.agg(F.count("*").alias("entry_count"), F.countDistinct("author_key").alias("author_count"), F.count(F.when(F.col("needs_manual_review"), 1)).alias("to_review"))
    parts = parts.unionByName(out.ignored.agg(F.count("*").alias("ignored_count"), F.count(F.when(superseded, 1)).alias("superseded_count")), allowMissingColumns=True)
    parts = parts.unionByName(out.warnings.agg(F.count(F.when(F.col("type") == "runtime_warning", 1)).alias("warning_count")), allowMissingColumns=True)
    parts = parts.unionByName(candidates.agg(F.count("*").alias("candidate_count")), allowMissingColumns=True)
    names = ("candidate_count", "entry_count", "author_count", "ignored_count", "superseded_count", "warning_count")
    return parts.agg(*[F.max(c).alias(c) for c in names], (F.max("to_review") + F.max("warning_count") > 0).alias("manual_review_required"))


def tally(spark: SparkSession, posts: DataFrame, rule: Rule, classifier: Callable[[str], str] | None = None, unescape=unescaped_twice, prompt: Column | None = None, limits: Limits | None = None) -> Tally:
    """posts: ord, lou, pid, uid, username, postdate, content, author_key. Without a classifier every post is for somebody to look at. For prompt and limits see classified."""
    folder = shared_folder(spark)
    cleaned = posts.withColumns({"reply": reply_context(F.col("content"), unescape), "raw": F.col("content"), "content": cleaned_post(F.col("content"), unescape)})
    cleaned = keep(cleaned, f"{folder}/cleaned")
    candidates, ignored = split_posts(cleaned, rule, "content", "raw")
    candidates = candidates.withColumns({"hint": weight_hint(F.col("content")), "weight_only": is_weight_only(F.col("content")), "asks": asks_weight(F.col("content")), "proxy": proxy_reason(F.col("content"))})
    candidates = keep(candidates, f"{folder}/candidates")
    refusals = ignored.select("author_key", "lou", F.lit(None).cast("string").alias("topic_id"), "ignore_reason", "stage", F.lit(None).cast("long").alias("superseded_by_lou"))
    warnings = spark.createDataFrame([], "lou long, message string")
    if classifier is None:
        proposals = unclassified(candidates)
    else:
        # only replies that ask for weight show what they reply to
        context = reply_context_posts(candidates.select("author_key", "lou", "pid", F.when(F.col("asks"), F.col("reply.reply_to_pid")).alias("reply_to_pid")), cleaned)
        # kept, so that no pack is sent to the classifier twice
        replies = keep(classified(author_packs(candidates, context), classifier, prompt=prompt, limits=limits), f"{folder}/replies")
        proposals, refused, warnings = normalised(candidates, replies, rule.topics)
        proposals, refused = keep(proposals, f"{folder}/proposals"), keep(refused, f"{folder}/refused")
        proposals = keep(named(proposals, candidates), f"{folder}/named")
        warnings = warnings_that_hold(warnings, proposals.where("topic_id = 'theme4_carriage_name'"))
        proposals, refused, unmet = recovered_weights(proposals, refused, candidates)
        warnings = keep(warnings.unionByName(unmet), f"{folder}/warnings")
        proposals, refused = keep(proposals, f"{folder}/weighted"), keep(refused.drop("ord"), f"{folder}/left")
        refusals = refusals.unionByName(refused)
    # of an author's posts on one floor (a page read twice) the first holds
    own = candidates.groupBy("author_key", F.col("lou").alias("chosen_lou")).agg(F.min(F.struct("ord", "hint", "proxy", F.col("content").alias("post"))).alias("own"))
    proposals = proposals.join(own.select("author_key", "chosen_lou", "own.hint", "own.proxy", "own.post"), ["author_key", "chosen_lou"], "left")
    several = [t.id for t in rule.topics if t.allow_multiple_per_author]
    free = " or ".join(["topic_id = 'unclassified'", "proxy is not null", *(f"topic_id = '{t}'" for t in several)])
    kept, lost = latest_wins(proposals, free)
    entries = entry_ids(kept, {t.id: n for n, t in enumerate(rule.topics)})
    entries = keep(entries, f"{folder}/entries")
    entries = topic_names(entries, topic_table(spark, rule.topics))
    targets = weighted_targets(entries.select("entry_id", "topic_id", "hint", field_texts(F.col("fields")).alias("fields"), F.col("post").alias("content")))
    targets = targets.select(F.col("asker").alias("entry_id"), F.col("target").alias("weighted_entry_id"), F.col("note").alias("weight_note"))
    entries = entries.join(targets, "entry_id", "left").withColumn("needs_manual_review", F.col("needs_manual_review") | F.col("weight_note").isNotNull())
    refusals = refusals.unionByName(superseded_rows(lost).select("author_key", "lou", "topic_id", "ignore_reason", "stage", "superseded_by_lou"))
    out = Tally(entries, author_anchors(entries), refusals, warning_details(entries, warnings), topic_counts(entries), missing_ranges(posts, rule.start_lou, rule.end_lou), raw_stats(posts))
    out.counts = run_counts(out, candidates)
    return out
