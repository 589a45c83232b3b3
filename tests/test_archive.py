"""Images in HTML and their sizes against plain versions."""

from __future__ import annotations

import random
import re
import struct
import zlib
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from postloom import queries_archive as qa
from postloom.functions.dom import VOID, dom_images, images_in
from postloom.functions.images import decoded_size, image_size
from postloom.plans import archive


class Tree(HTMLParser):
    """Nodes as [name, attributes, children, parent] or text; an end without a beginning counts for nothing."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.at = ["", {}, [], None]
        self.images = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs, closed=False):
        node = [tag, {k: v or "" for k, v in attrs}, [], self.at]
        self.at[2].append(node)
        if tag == "img":
            self.images.append(node)
        if tag not in VOID and not closed:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        up = self.at
        while up is not self.root and up[0] != tag:
            up = up[3]
        if up is not self.root:
            self.at = up[3]

    def handle_data(self, data):
        self.at[2].append(data)

    def handle_comment(self, data):
        self.at[2].append(("note", data))


def inner(node) -> list[str]:
    return [s for c in node[2] for s in ([c.strip()] if isinstance(c, str) else inner(c) if isinstance(c, list) else []) if s]


def plain_images(html: str) -> list[tuple]:
    out = []
    for img in Tree(html).images:
        siblings = img[3][2]
        rest = siblings[next(k for k, c in enumerate(siblings) if c is img) + 1 :]
        following, breaks = "", 0
        for c in rest:
            text = c.strip() if isinstance(c, str) else c[1].strip() if isinstance(c, tuple) else "" if c[0] == "br" else " ".join(inner(c))
            if text:
                following = text[:48]
                break
        for c in rest:
            if isinstance(c, list) and c[0] == "br":
                breaks += 1
            elif not isinstance(c, str) or c.strip():
                break
        out.append((img[1].get("src"), img[1].get("alt"), img[1].get("class"), following, breaks))
    return out


def found(html: str) -> list[tuple]:
    return [(i[2], i[4], i[5], i[7], len(i[8])) for i in images_in(html)]


PIECES = ["<p>", "</p>", "<div class='a'>", "</div>", "<b>", "</b>", "<br>", "<br/>", " <br /> ", "text &amp; more", "  ", "\n", "甲：乙", "<!-- note -->", "<span/>", "</i>", "<hr>", "<a href='x>y'>", "</a>"]
PIECES += ['<img src="a/b.png" class="c d">', "<img src='x.jpg?v=1' alt=\"q\"/>", "<IMG SRC=z.gif>", "<img>", '<img src="" alt>', '<img alt="a &gt; b" src="&amp;.png">']


def test_images_in_html():
    pick = random.Random(1)
    for _ in range(4000):
        html = "".join(pick.choice(PIECES) for _ in range(pick.randrange(1, 30)))
        assert found(html) == plain_images(html), html
    assert found("<script>var a = '<img src=x>';</script><img src=y>z") == [("y", None, None, "z", 0)]
    assert found("<style>p{}</style> <!-- <img src=x> --> <img") == []
    assert images_in("") == []


def test_places(spark):
    """Places count characters, so that stretches cut by them are the attributes and breaks themselves."""
    html = "\U0001f437é<p><img class=k src='b.png'> <br>\U0001f437<br></p>"
    row = spark.createDataFrame([(html,), (None,), ("",)], "h string").select("h", dom_images("h").alias("x")).collect()
    (image,) = row[0].x
    assert html[image.start : image.stop] == "<img class=k src='b.png'>"
    assert html[image.src_at.start : image.src_at.stop] == "b.png"
    assert html[image.class_at.start : image.class_at.stop] == "k"
    assert [html[b.start : b.stop] for b in image.breaks] == ["<br>"]
    assert [r.x for r in row[1:]] == [[], []]


def png(width, height):
    return b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", width, height) + b"\x08\x02\0\0\0"


def test_sizes_of_files(spark):
    app = b"\xff\xe1" + struct.pack(">H", 300) + b"\xff\xc0" * 149  # a thumbnail's frame inside a segment does not count
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 33, 44, 1) + b"\1\x11\0"
    cases = {
        png(3, 70000): ("png", (3, 70000)),
        b"GIF89a" + struct.pack("<HH", 5, 6): ("gif", (5, 6)),
        b"BM" + bytes(12) + struct.pack("<Iii", 40, 7, -8): ("bmp", (7, 8)),
        b"BM" + bytes(12) + struct.pack("<IHH", 12, 9, 10): ("bmp", (9, 10)),
        b"\xff\xd8" + app + b"\xff\xff" + frame: ("jpeg", (44, 33)),
        b"\xff\xd8" + app: ("jpeg", None),
        b"\xff\xd8" + app + b"\xff\xda\0\x04": ("jpeg", None),
        b"\xff\xd8\xff\xe0\0\1": ("jpeg", None),
        b"\xff\xd8\0\0\0\0": ("jpeg", None),
        png(3, 4)[:20]: ("png", None),
        b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0abc": ("webp", None),
        b"GIF89a\1": ("gif", None),
        b"text": (None, None),
        b"": (None, None),
    }
    assert {k: image_size(k) for k in cases} == cases
    for k in cases:
        for n in range(len(k)):
            image_size(k[:n])  # cut anywhere
    rows = [(k,) for k in cases] + [(None,), (png(0, 5),)]
    got = spark.createDataFrame(rows, "c binary").select(decoded_size("c").alias("s")).collect()
    want = [(f, *(s or (None, None)), s is None) for f, s in cases.values()] + [(None, None, None, True), ("png", None, None, True)]
    assert [tuple(r.s) for r in got] == want


def test_printable(spark):
    html = [
        (1, '<p><img src="http://h/a.png?x=1"><br> <br>甲：你好</p>'),
        (2, '<img src="http://h/b.png" class="big" alt="l&quot;ong">tail<img src="c.png" class="k">\nNOT: a speaker'),
        (3, '<img src="copy.png" class="k"><b>Anna</b>: hi &amp;#9834;'),
        (4, "no image"),
        (5, '<img src="bad.png">'),
    ]
    files = [("a.png", png(100, 100)), ("b.png", png(800, 4000)), ("c.png", png(100, 100) + b"x"), ("copy.png", png(100, 100)), ("bad.png", b"?")]
    pages = spark.createDataFrame(html, "lou long, html string")
    sized = archive.image_files(spark.createDataFrame(files, "filename string, content binary"))
    got = {r.lou: r.html for r in archive.printable(pages, sized).collect()}
    slices = "".join(f'<img src="long_image_slices/b_slice_{k:03d}.jpg" alt="l&quot;ong" class="long-image-slice"/>' for k in range(4))
    assert got == {
        1: '<p><img class="speaker-portrait" src="http://h/a.png?x=1"> 甲：你好</p>',
        2: f'<div class="long-image-slices">{slices}</div>tail<img src="c.png" class="k">\nNOT: a speaker',
        3: '<img src="../images/a.png" class="k"><b>Anna</b>: hi &#9834;',
        4: "no image",
        5: '<img src="bad.png">',
    }
    assert archive.local_links(pages).where("lou = 1").first()["html"] == '<p><img src="../images/a.png"><br> <br>甲：你好</p>'
    links = {(r.lou, r.n, r.path, r.valid) for r in archive.image_links(archive.page_images(pages)).collect()}
    assert links == {(1, 0, "a.png", False), (2, 0, "b.png", False), (2, 1, "c.png", False), (3, 0, "copy.png", False), (5, 0, "bad.png", False)}
    assert archive.manifest(pages).where("collision").count() == 0
    with pytest.raises(Exception, match="missing image"):
        archive.printable(pages, sized.where("filename <> 'c.png'")).collect()


def test_printable_pages(spark, sf_dir):
    """The registered query against a plain rewriting of every page."""
    pages = {r.lou: r.html for r in qa.illustrated(spark, sf_dir).collect()}
    names = sorted({i[0].split("?")[0].split("/")[-1] for h in pages.values() for i in plain_images(h)})
    size = {n: (len(n) * 60, len(n) * 60 * (zlib.crc32(n.encode()) % 7)) for n in names}
    first = {}
    for n in names:
        first.setdefault(size[n], n)

    def page(html):
        out, at = [], 0
        for tag, image in zip(re.finditer(r'<img alt="link" src="([^"]*)">', html), plain_images(html), strict=True):
            name = image[0].split("?")[0].split("/")[-1]
            w, h = size[name]
            same = first[w, h]
            new = tag[0] if same == name else f'<img alt="link" src="../images/{same}">'
            end = tag.end()
            if h and w >= 800 and h / w >= 4:
                stem = re.sub("[^A-Za-z0-9_.-]+", "_", same.rsplit(".", 1)[0])
                new = '<div class="long-image-slices">' + "".join(f'<img src="long_image_slices/{stem}_slice_{k:03d}.jpg" alt="link" class="long-image-slice"/>' for k in range(-(-h // int(w * 1.35)))) + "</div>"
            elif h and max(w, h) <= 420 and 0.45 <= h / w <= 3 and re.match(r"[^\s：:][^：:]{0,15}[：:]", image[3]):
                raise AssertionError("no page has a speaker")
            out += [html[at : tag.start()], new]
            at = end
        return "".join([*out, html[at:]]).replace("&amp;#", "&#")

    want = spark.createDataFrame([(k, page(h)) for k, h in pages.items()], "lou long, html string").select("lou", F.md5("html").alias("digest"))
    got = qa.printable_pages(spark, sf_dir).select("lou", "digest")
    assert got.exceptAll(want).count() == 0 and got.count() == len(pages)
