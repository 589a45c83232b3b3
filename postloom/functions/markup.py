"""Post markup to text: Column -> Column. Patterns are Java's; (?U) gives \\s and \\d their Unicode meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.entities import unescaped_twice

#: The reply-quote block and what it holds.
REPLY_QUOTE = r"(?iusU)\[quote\]\s*\[pid=(\d+)(?:,(\d+),(\d+))?\]Reply\[/pid\](.*?)\[/quote\]"
QUOTED_AUTHOR = r"(?iuU)Post by \[uid=\d+\]([^\[]+)\[/uid\]"
QUOTED_HEAD = r"(?iusU)\A\s*<b>Post by .*?</b>\s*(?:<br\s*/?>\s*)*"
KNOWN_TAGS = r"(?i)\[/?(?:quote|b|i|u|s|del|color|size|align|url|collapse|fold|pid|tid)[^\]]*\]"
ANY_TAG = r"(?i)\[(?:/?[A-Za-z*][^\]]*|s:[^\]]+)\]"
#: One of these is in every text that cleaning changes, white space at its ends aside.
MARKED = "[\\[<&\\r\\n\u00a0]"
TRUNCATED = "\n...[已截断]"
#: Markup rules, in the order in which they are applied.
BBCODE_RULES = (
    (r"\[b\](.*?)\[/b\]", "<strong>$1</strong>"),
    (r"\[i\](.*?)\[/i\]", "<em>$1</em>"),
    (r"\[u\](.*?)\[/u\]", "<u>$1</u>"),
    (r"\[s\](.*?)\[/s\]", "<del>$1</del>"),
    (r"\[url=(.*?)\](.*?)\[/url\]", '<a href="$1">$2</a>'),
    (r"\[img\](.*?)\[/img\]", '<img src="$1" alt="" />'),
    (r"\[quote\](.*?)\[/quote\]", "<blockquote>$1</blockquote>"),
    (r"\[code\](.*?)\[/code\]", "<pre><code>$1</code></pre>"),
    (r"\[color=(.*?)\](.*?)\[/color\]", '<span style="color:$1">$2</span>'),
    (r"\[size=(.*?)\](.*?)\[/size\]", '<span style="font-size:$1">$2</span>'),
)
BBCODE_PASSES = 3
IMAGE_LINK = r"^https://img\.nga\.178\.com/attachments/mon_\d{6}/\d{2}/.+$"
POST_URL = "https://ngabbs.com/read.php?pid=%s&opt=128"
PAGE_POSTS, CELL_LIMIT = 20, 32767


def sub(c: Column, *rules: tuple[str, str]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return sub(c, (r"(?U)\A\s+|\s+\z", ""))


def unescaped_basic(c: Column) -> Column:
    """The five entities that markup needs, twice. Numbered and other named entities are left."""
    for _ in range(2):
        for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            c = F.replace(c, F.lit(name), F.lit(to))
    return c


def without_reply_quotes(c: Column) -> Column:
    return sub(c, (REPLY_QUOTE, ""))


def reply_quotes(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(REPLY_QUOTE)), F.lit(0))


def clean_post(c: Column, unescape=unescaped_twice) -> Column:
    """Text of a post; null counts as empty."""
    c = without_reply_quotes(F.coalesce(c, F.lit("")))
    c = sub(c, (r"(?iuU)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|li|tr|h[1-6])>", "\n"), (r"(?is)\[img\].*?\[/img\]", ""), (r"<[^>]+>", ""), (KNOWN_TAGS, ""), (ANY_TAG, ""))
    c = sub(unescape(c), (r"\r\n?", "\n"), ("\u00a0", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"))
    return strip(c)


def cleaned_post(c: Column, unescape=unescaped_twice) -> Column:
    """clean_post of a column that is there, where unescape acts on & alone: a text without anything that the rules act on is only stripped."""
    return F.when(c.rlike(MARKED), clean_post(c, unescape)).otherwise(strip(F.coalesce(c, F.lit(""))))


def clean_legacy(c: Column) -> Column:
    """The older tally's cleaning: quoted bodies stay, line breaks in three spellings only."""
    c = sub(F.coalesce(c, F.lit("")), (r"<br>|<br/>|<br />", "\n"), (r"<[^>]+>", ""), (r"(?s)\[img\].*?\[/img\]", ""), (r"\[/?[^\]]+\]", ""))
    return strip(F.replace(c, F.lit("&quot;"), F.lit('"')))


def bbcode_to_html(c: Column) -> Column:
    for _ in range(BBCODE_PASSES):
        c = sub(c, *((f"(?is){pattern}", to) for pattern, to in BBCODE_RULES))
    return c


def without_bbcode(c: Column) -> Column:
    return sub(c, (r"\[/?[a-zA-Z]+(?:=[^\]]+)?\]", ""))


def compact(c: Column) -> Column:
    c = sub(strip(c), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))
    return sub(c, (r"\A[ \n：:]+|[ \n：:]+\z", ""))


def truncated(c: Column, limit: int) -> Column:
    return c if limit <= 0 else F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(TRUNCATED))).otherwise(c)


def cell_text(c: Column, limit: int = CELL_LIMIT) -> Column:
    """For a spreadsheet cell: marker included, no longer than the limit."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - len(TRUNCATED)), F.lit(TRUNCATED))).otherwise(c)


def snippet(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def reply_context(c: Column, unescape=unescaped_twice) -> Column:
    """Struct of the first reply quote and the number of all."""
    group = lambda k: F.nullif(F.regexp_extract(c, REPLY_QUOTE, k), F.lit(""))
    body = F.regexp_extract(c, REPLY_QUOTE, 4)
    preview = compact(clean_post(sub(body, (QUOTED_HEAD, "")), unescape))
    n = reply_quotes(c)
    found = F.struct(
        (n > 0).alias("has_reply_quote"),
        n.alias("reply_quote_count"),
        group(1).cast("long").alias("reply_to_pid"),
        group(2).cast("long").alias("reply_to_tid"),
        group(3).cast("long").alias("reply_to_page"),
        F.nullif(strip(F.regexp_extract(body, QUOTED_AUTHOR, 1)), F.lit("")).alias("reply_to_author"),
        F.when(n > 0, F.nullif(truncated(preview, 160), F.lit(""))).alias("quoted_preview"),
    )
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(x) for x in names]
    nothing = F.struct(F.lit(False).alias("has_reply_quote"), F.lit(0).alias("reply_quote_count"), *none("long", "reply_to_pid", "reply_to_tid", "reply_to_page"), *none("string", "reply_to_author", "quoted_preview"))
    return F.when(F.contains(c, F.lit("[")), found).otherwise(nothing)


def sheet_title(c: Column, default: str = "Sheet") -> Column:
    c = strip(sub(F.translate(c, "[]:*?/\\", "_______"), (r"(?U)\s+", " ")))
    return F.when(F.coalesce(c, F.lit("")) == "", default).otherwise(F.substring(c, 1, 31))


def export_reason(c: Column) -> Column:
    """Without the parts that say that the author or the floor is on a list."""
    parts = F.filter(F.transform(F.split(c, "[；;]"), strip), lambda x: (x != "") & ~x.rlike(r"^作者 uid=\S+ 在忽略名单中$") & ~x.rlike(r"^楼层 \S+ 在忽略楼层名单中$"))
    return F.array_join(parts, "；")


def search_text(*columns: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def is_image_link(c: Column) -> Column:
    return c.rlike(IMAGE_LINK)


def file_name(url: Column) -> Column:
    """Last part of the path, without the query."""
    return F.element_at(F.split(F.element_at(F.split(url, r"\?"), 1), "/"), -1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def post_url(pid: Column) -> Column:
    return F.when(strip(pid.cast("string")) != "", F.format_string(POST_URL, strip(pid.cast("string"))))


def floor_label(floors: Column, own: Column) -> Column:
    """#a, #b of the floors; the own floor where there are none."""
    floors = F.when(F.size(F.coalesce(floors, F.array())) == 0, F.array(own)).otherwise(floors)
    return F.array_join(F.transform(floors, lambda x: F.concat(F.lit("#"), x.cast("string"))), ", ")


def author_label(name: Column, uid: Column) -> Column:
    return F.coalesce(F.nullif(strip(name), F.lit("")), F.concat(F.lit("uid:"), uid.cast("string")), F.lit("unknown"))


def is_speaker(name: Column) -> Column:
    """Whether the name before a colon looks like a speaker's."""
    bare = sub(strip(name), (r"\A[\"'“”‘’]+|[\"'“”‘’]+\z", ""))
    canonical = strip(F.translate(sub(bare, (r"[（(][^）)]*[）)]", "")), "/／", ""))
    ascii_only = canonical.rlike(r"\A[\x00-\x7F]*\z")
    shouts = canonical.rlike("[A-Z]") & ~canonical.rlike("[a-z]")
    return (
        F.when(bare.isNull() | (bare == "") | bare.rlike(r"\A[\[<]"), False)
        .when(bare.rlike(r"\A[?？!！]+\z"), True)
        .when(canonical == "", False)
        .when(canonical.rlike("[\u4e00-\u9fff]"), True)
        .when(ascii_only, ~shouts)
        .otherwise(True)
    )


def speaker(line: Column) -> Column:
    """The name that a line begins with, where it looks like a speaker's."""
    name = F.regexp_extract(line, r"(?U)\A([^\s：:][^：:]{0,15})[：:]", 1)
    return F.when((name != "") & is_speaker(name), name)
