"""Images in HTML: a stream of tokens with a stack of open elements finds them, JVM-side edits rewrite them.

Python reads each text once and returns places; what is done with an image is decided and
applied by columns, so that sizes and names can come from a join.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without content, and those whose content is raw text.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
RAW = frozenset({"script", "style"})
#: How much of the text after an image is looked at; classes of rewritten images.
FOLLOWING, PORTRAIT, SLICES, SLICE = 48, "speaker-portrait", "long-image-slices", "long-image-slice"

TOKEN = re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?](?P<note>[^>]*)>|</(?P<close>[A-Za-z][^\s/>]*)[^>]*>|<(?P<open>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

SPAN = T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType())
IMAGE = T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType()).add("src", T.StringType()).add("src_at", SPAN).add("alt", T.StringType())
IMAGE = IMAGE.add("class", T.StringType()).add("class_at", SPAN).add("following", T.StringType()).add("breaks", T.ArrayType(SPAN))


def tokens(html: str) -> Iterator[tuple[str, str, int, int, str]]:
    """(kind, name or text, start, stop, rest): kinds are text, note (a comment, whose text is the name), open, empty and close."""
    at, raw = 0, ""
    while at < len(html):
        if raw:  # nothing but the element's own end counts
            end = re.compile(rf"</{raw}[\s/>]", re.I).search(html, at)
            stop = end.start() if end else len(html)
            if stop > at:
                yield "raw", html[at:stop], at, stop, ""
            at, raw = stop, ""
            continue
        found = TOKEN.search(html, at)
        stop = found.start() if found else len(html)
        if stop > at:
            yield "text", html[at:stop], at, stop, ""
        if not found:
            return
        at = found.end()
        if found["comment"] is not None or found["note"] is not None:
            yield "note", found["comment"] if found["comment"] is not None else found["note"], stop, at, ""
        elif found["close"] is not None:
            yield "close", found["close"].lower(), stop, at, ""
        else:
            name = found["open"].lower()
            closed = name in VOID or found["rest"].rstrip().endswith("/")
            yield "empty" if closed else "open", name, stop, at, found["rest"]
            raw = name if name in RAW and not closed else ""


class Nodes:
    """Elements and texts in order of appearance; parent[k] is the node around node k (-1: none), last[k] the last node inside it."""

    def __init__(self, html: str):
        self.kind, self.name, self.start, self.stop, self.rest, self.parent, self.last = [], [], [], [], [], [], []
        stack: list[int] = []
        for kind, name, start, stop, rest in tokens(html):
            if kind == "close":
                if any(self.name[k] == name for k in stack):
                    while True:
                        k = stack.pop()
                        self.last[k] = len(self.kind) - 1
                        if self.name[k] == name:
                            break
                continue
            self.kind.append(kind)
            self.name.append(name)
            self.start.append(start)
            self.stop.append(stop)
            self.rest.append(rest)
            self.parent.append(stack[-1] if stack else -1)
            self.last.append(len(self.kind) - 1)
            if kind == "open":
                stack.append(len(self.kind) - 1)
        for k in stack:
            self.last[k] = len(self.kind) - 1

    def after(self, k: int) -> Iterator[int]:
        """The nodes that follow node k inside the same parent."""
        end = self.last[self.parent[k]] if self.parent[k] >= 0 else len(self.kind) - 1
        at = self.last[k] + 1
        while at <= end:
            yield at
            at = self.last[at] + 1

    def text(self, k: int) -> str:
        """Texts inside an element, without white space around each, joined by spaces; a text or comment as it is."""
        if self.kind[k] in ("text", "note", "raw"):
            return (entities.unescape(self.name[k]) if self.kind[k] == "text" else self.name[k]).strip()
        inside = range(k + 1, self.last[k] + 1)
        own = self.name[k] in RAW
        parts = (entities.unescape(self.name[n]).strip() if self.kind[n] == "text" else self.name[n].strip() for n in inside if self.kind[n] == "text" or own and self.kind[n] == "raw")
        return " ".join(p for p in parts if p)


def images_in(html: str) -> list[tuple]:
    """What IMAGE says of each <img>: its tag's place, its attributes and theirs, the first text that follows it inside its parent, and the line breaks right after it."""
    if "<img" not in html.lower():
        return []
    nodes, out = Nodes(html), []
    for k, name in enumerate(nodes.name):
        if name != "img" or nodes.kind[k] not in ("open", "empty"):
            continue
        values: dict[str, tuple[str, dict | None]] = {}
        base = nodes.start[k] + len("<img")
        for m in ATTRIBUTE.finditer(nodes.rest[k]):
            group = next((g for g in (2, 3, 4) if m[g] is not None), 0)
            # of repeated attributes the last one holds
            values[m[1].lower()] = (entities.unescape(m[group]) if group else "", {"start": base + m.start(group), "stop": base + m.end(group)} if group else None)
        src, alt, cls = (values.get(a, (None, None)) for a in ("src", "alt", "class"))
        following = next((t for n in nodes.after(k) if nodes.name[n] != "br" or nodes.kind[n] in ("text", "note", "raw") if (t := nodes.text(n))), "")
        breaks = []
        for n in nodes.after(k):
            if nodes.kind[n] in ("text", "note", "raw"):
                if nodes.name[n].strip():
                    break
            elif nodes.name[n] == "br":
                breaks.append({"start": nodes.start[n], "stop": nodes.stop[n]})
            else:
                break
        out.append((nodes.start[k], nodes.stop[k], src[0], src[1], alt[0], cls[0], cls[1], following[:FOLLOWING], breaks))
    return out


@F.pandas_udf(T.ArrayType(IMAGE))
def dom_images(html: pd.Series) -> pd.Series:
    """The images of each text in order (see images_in); null and texts without any give none. Places count characters from 0."""
    return html.map(lambda h: [dict(zip(IMAGE.names, i, strict=True)) for i in images_in(h or "")])


def edit(start: Column, stop: Column, text: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), text.alias("text"))


def edited(html: Column, edits: Column) -> Column:
    """html with each stretch start..stop replaced by its text. edits: by place, none overlapping another; null counts as none."""
    edits = F.coalesce(edits, F.array().cast("array<struct<start:int,stop:int,text:string>>"))
    before = lambda k: F.coalesce(F.get(edits, k - 1)["stop"], F.lit(0))
    pieces = F.transform(edits, lambda e, k: F.concat(F.substring(html, before(k) + 1, e["start"] - before(k)), e["text"]))
    return F.concat(F.array_join(pieces, ""), F.substr(html, before(F.size(edits)) + 1))


def quoted(c: Column) -> Column:
    """For an attribute in double quotes."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


def src_edit(image: Column, src: Column) -> Column:
    """The image's address replaced; in double quotes where it stood without any."""
    return edit(image["src_at"]["start"], image["src_at"]["stop"], quoted(src))


def portrait_edits(image: Column) -> Column:
    """The class of portraits of speakers added, and the breaks that follow taken out."""
    held = F.array_contains(F.split(F.coalesce(image["class"], F.lit("")), r"\s+"), PORTRAIT)
    named = F.when(image["class_at"].isNotNull(), edit(image["class_at"]["stop"], image["class_at"]["stop"], F.lit(f" {PORTRAIT}")))
    named = named.otherwise(edit(image["start"] + len("<img"), image["start"] + len("<img"), F.lit(f' class="{PORTRAIT}"')))
    return F.concat(F.when(held, F.array().cast("array<struct<start:int,stop:int,text:string>>")).otherwise(F.array(named)), F.transform(image["breaks"], lambda b: edit(b["start"], b["stop"], F.lit(""))))


def slices_edit(image: Column, paths: Column) -> Column:
    """The image replaced by its slices."""
    each = F.transform(paths, lambda p: F.concat(F.lit('<img src="'), quoted(p), F.lit('" alt="'), quoted(image["alt"]), F.lit(f'" class="{SLICE}"/>')))
    return edit(image["start"], image["stop"], F.concat(F.lit(f'<div class="{SLICES}">'), F.array_join(each, ""), F.lit("</div>")))
