"""Backup of a thread: HTML of posts, image links, sizes, slices, rewritten pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.dom import dom_images, edited, portrait_edits, slices_edit, src_edit
from postloom.functions.images import decoded_size
from postloom.functions.markup import bbcode_to_html, file_name, is_image_link, speaker
from postloom.functions.scalars import is_long, is_portrait, slice_starts
from postloom.operators.gaps import missing_ranges
from postloom.operators.links import canonical_files, download_manifest
from postloom.shipping import ship

IMAGES, SLICED = "../images/", "long_image_slices/"


def post_html(posts: DataFrame) -> DataFrame:
    """(lou, html) of posts, with a placeholder for each floor missing before the last."""
    there = posts.select("lou", bbcode_to_html(F.col("content")).alias("html"))
    gaps = missing_ranges(posts, start=1).select(F.explode(F.sequence("start", "end")).alias("lou"))
    return there.unionByName(gaps.withColumn("html", F.lit("<p><em>本楼层内容缺失。</em></p>")))


def page_images(html: DataFrame) -> DataFrame:
    """One row for each image that has an address: lou, n (its place among all of the floor, from 0), image (see dom_images), filename. html: lou, html; a floor once."""
    ship(html.sparkSession)
    found = html.select("lou", F.posexplode(dom_images("html")).alias("n", "image"))
    return found.where(F.coalesce(F.col("image.src"), F.lit("")) != "").withColumn("filename", file_name(F.col("image.src")))


def image_links(images: DataFrame) -> DataFrame:
    """(lou, n, url, path, valid) of page_images: what is to be downloaded, and whether the address is one of the thread's host."""
    return images.select("lou", "n", F.col("image.src").alias("url"), F.col("filename").alias("path"), is_image_link(F.col("image.src")).alias("valid"))


def attribute_links(html: DataFrame, attribute: str) -> DataFrame:
    """(lou, url, path): what stands in an attribute, in double quotes, of any element; the path is the last part of the address."""
    urls = F.regexp_extract_all("html", F.lit(rf'(?i){attribute}="([^"]+)"'), F.lit(1))
    return html.select("lou", F.explode(urls).alias("url")).withColumn("path", file_name(F.col("url")))


def manifest(html: DataFrame) -> DataFrame:
    return download_manifest(image_links(page_images(html)).select("url", "path"))


def image_files(files: DataFrame) -> DataFrame:
    """(filename, canonical, format, width, height, broken) of files (filename, content): the first name of each content, with the size its header says."""
    ship(files.sparkSession)
    sized = files.select("filename", decoded_size("content").alias("s")).select("filename", "s.*")
    return canonical_files(files).select("filename", "canonical").join(sized, "filename")


def rewrites(images: DataFrame, how) -> DataFrame:
    """(lou, edits): edits of page_images by floor, in order. how: a column of arrays of edits."""
    each = images.select("lou", F.explode(how).alias("e"))
    return each.groupBy("lou").agg(F.array_sort(F.collect_list("e")).alias("edits"))  # the images of one floor


def applied(html: DataFrame, edits: DataFrame) -> DataFrame:
    return html.join(edits, "lou", "left").withColumn("html", edited(F.col("html"), F.col("edits"))).drop("edits")


def local_links(html: DataFrame) -> DataFrame:
    """html with images pointing to the local folder; floors without images stay as they are."""
    images = page_images(html)
    return applied(html, rewrites(images, F.array(src_edit(F.col("image"), F.concat(F.lit(IMAGES), F.col("filename"))))))


def slice_paths(name: Column, width: Column, height: Column, extension: str = ".jpg", folder: str = SLICED) -> Column:
    """Names of an image's slices from the top, none where it fits one."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"[^A-Za-z0-9_.-]+", "_")
    return F.transform(slice_starts(width, height), lambda _, k: F.concat(F.lit(folder), stem, F.lit("_slice_"), F.lpad(k.cast("string"), 3, "0"), F.lit(extension)))


def printable(html: DataFrame, files: DataFrame) -> DataFrame:
    """(lou, html) for printing: images of one content share one name, long ones are replaced by their slices, portraits of speakers are marked and closed up with their text.

    files: as image_files gives them. A name that is no file fails the run; a broken image
    only gets its shared name.
    """
    image, width, height = F.col("image"), F.col("width"), F.col("height")
    found = page_images(html).join(files, "filename", "left")
    found = found.withColumn("canonical", F.when(F.col("canonical").isNull(), F.raise_error(F.concat(F.lit("missing image "), "filename"))).otherwise(F.col("canonical")))
    renamed = F.when(F.col("canonical") != F.col("filename"), F.array(src_edit(image, F.concat(F.lit(IMAGES), F.col("canonical"))))).otherwise(F.array().cast("array<struct<start:int,stop:int,text:string>>"))
    slices = slice_paths(F.col("canonical"), width, height)
    long = F.coalesce(is_long(width, height) & (F.size(slices) > 0), F.lit(False))
    portrait = F.coalesce(is_portrait(width, height) & speaker(image["following"]).isNotNull(), F.lit(False))
    how = F.when(long, F.array(slices_edit(image, slices))).when(portrait, F.concat(renamed, portrait_edits(image))).otherwise(renamed)
    out = applied(html, rewrites(found, how))
    return out.withColumn("html", F.replace("html", F.lit("&amp;#"), F.lit("&#")))  # numbered characters that were escaped twice
