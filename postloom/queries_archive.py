"""Registered queries of the archive: images in pages, their sizes, pages for printing.

The links of `pages` stand in for images: each becomes an <img> and a line break before the link's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.images import decoded_size
from postloom.plans import archive
from postloom.queries import query, table


def illustrated(spark, sf_dir) -> DataFrame:
    html = F.regexp_replace("html", r'<a href="([^"]*)">', '<img alt="link" src="$1.png?v=1"><br>')
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("lou"), html.alias("html"))


@query(
    """with l as (select page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)', 1) texts from pages),
    x as (select page_id, unnest(hrefs) href, unnest(texts) t, generate_subscripts(hrefs, 1) - 1 n from l)
    select page_id lou, n::int n, href || '.png?v=1' src, list_last(string_split(href, '/')) || '.png' filename,
      substr(trim(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), 1, 48) following, 1 breaks from x"""
)
def page_images(spark, sf_dir):
    """Every image of every page with its address, the text that follows it and the breaks between the two."""
    found = archive.page_images(illustrated(spark, sf_dir))
    return found.select("lou", "n", "image.src", "filename", "image.following", F.size("image.breaks").alias("breaks"))


def big(n: Column, size: int) -> Column:
    return F.lpad(F.hex(n), 2 * size, "0")


def little(n: Column, size: int) -> Column:
    whole = big(n, size)
    return F.concat(*[F.substring(whole, 2 * k + 1, 2) for k in reversed(range(size))])


def headers(width: Column, height: Column) -> dict[str, Column]:
    """Hexadecimal headers of files of these sizes, one for each format and variant."""
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFFFC4000401AAFFC2001108"), big(height, 2), big(width, 2), F.lit("03"))
    bits = (width - 1) + (height - 1) * (1 << 14)
    riff = F.lit("52494646FFFFFFFF57454250")
    return {
        "png": F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(width, 4), big(height, 4), F.lit("0802000000")),
        "gif": F.concat(F.lit("474946383961"), little(width, 2), little(height, 2), F.lit("F70000")),
        "bmp": F.concat(F.lit("424D0000000000000000360000002800" + "0000"), little(width, 4), little(height, 4), F.lit("01001800")),
        "jpeg": jpeg,
        "webp lossy": F.concat(riff, F.lit("56503820FFFFFFFF0000009D012A"), little(width, 2), little(height, 2)),
        "webp lossless": F.concat(riff, F.lit("5650384CFFFFFFFF2F"), little(bits, 4)),
        "webp extended": F.concat(riff, F.lit("56503858FFFFFFFF00000000"), little(width - 1, 3), little(height - 1, 3)),
        "cut": F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(width, 4)),
    }


KINDS = "['png', 'gif', 'bmp', 'jpeg', 'webp lossy', 'webp lossless', 'webp extended', 'cut']"


@query(
    f"""with g as (select p_partkey, p_size * 40 w, cast(round(p_retailprice * 4) as int) h, unnest({KINDS}) kind from part)
    select p_partkey, kind, case when kind = 'cut' then 'png' else string_split(kind, ' ')[1] end format, case when kind <> 'cut' then w end::int width, case when kind <> 'cut' then h end::int height, kind = 'cut' broken from g"""
)
def image_sizes(spark, sf_dir):
    """Sizes are read back off headers that are made of them."""
    g = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40).cast("long").alias("w"), F.round(F.col("p_retailprice") * 4).cast("long").alias("h"))
    made = F.array(*[F.struct(F.lit(k).alias("kind"), F.unhex(c).alias("content")) for k, c in headers(F.col("w"), F.col("h")).items()])
    files = g.select("p_partkey", F.inline(made))
    return files.select("p_partkey", "kind", decoded_size("content").alias("s")).select("p_partkey", "kind", "s.*")


def files_of(pages: DataFrame) -> DataFrame:
    """(filename, content): a file for each image of the pages, with a size that its name decides; names of one length and size are one content."""
    names = archive.page_images(pages).select("filename").distinct()
    step = F.crc32(F.col("filename").cast("binary"))
    width = (F.length("filename") * 60).cast("long")
    content = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(width, 4), big(width * (step % 7), 4), F.lit("0802000000"))
    return names.select("filename", F.unhex(content).alias("content"))


@query()
def printable_pages(spark, sf_dir):
    """Pages for printing: one name for each content, long images in slices, portraits marked; tested against a plain version on the whole table."""
    pages = illustrated(spark, sf_dir)
    out = archive.printable(pages, archive.image_files(files_of(pages)))
    return out.select("lou", F.length("html").cast("long").alias("n"), F.md5("html").alias("digest"))


@query(
    r"""select page_id lou, md5(regexp_replace(regexp_replace(html, '<a href="([^"]*)">', '<img alt="link" src="\1.png"><br>', 'g'), '<img alt="link" src="[^"]*/([^"/]*)"><br>', '<img alt="link" src="../images/\1"><br>', 'g')) digest from pages"""
)
def local_links(spark, sf_dir):
    return archive.local_links(illustrated(spark, sf_dir)).select("lou", F.md5("html").alias("digest"))
