"""Numbers, arrays, maps and lenient JSON: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.markup import cell_text, strip

PAGE_POSTS = 20


def to_int(c: Column) -> Column:
    """Of text: an optional sign and digits, white space around them allowed; anything else is null."""
    return F.when(c.rlike(r"(?U)\A\s*[+-]?\d+\s*\z"), strip(c).try_cast("long"))


def whole(c: Column) -> Column:
    """Of a double: its value where that is whole, else null."""
    return F.when(c == F.floor(c), c.cast("long"))


def confidence(c: Column) -> Column:
    """Into 0 to 1; null stays."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double"))))


def page_of(lou: Column) -> Column:
    return (F.floor(lou / PAGE_POSTS) + 1).cast("long")


def percent_label(c: Column) -> Column:
    return F.concat(F.bround(c * 100).cast("long").cast("string"), F.lit("%"))


def percent_shown(c: Column) -> Column:
    """As readers see it on a screen: halves upwards, a note where there is none."""
    return F.coalesce(F.concat(F.floor(c * 100 + 0.5).cast("string"), F.lit("%")), F.lit("待复核"))


def flag_label(c: Column) -> Column:
    return F.when(c, F.lit("是")).otherwise(F.lit(""))


def is_portrait(width: Column, height: Column, most: int = 420, ratio: float = 3.0) -> Column:
    shape = height / F.greatest(width, F.lit(1))
    return (F.greatest(width, height) <= most) & (shape >= 0.45) & (shape <= ratio)


def is_long(width: Column, height: Column, least: int = 800, ratio: float = 4.0) -> Column:
    return (width >= least) & (height / F.greatest(width, F.lit(1)) >= ratio)


def slice_starts(width: Column, height: Column, ratio: float = 1.35) -> Column:
    """Where the slices of a long image begin; none where it fits one."""
    step = F.greatest(F.lit(1), (width * ratio).cast("int"))
    return F.when(height <= step, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), height - 1, step))


def row_height(length: Column, unit: int = 25) -> Column:
    return (F.floor(length / 100) + 1) * unit


def int_list(c: Column) -> Column:
    """Of an array of text: its integers, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, to_int), lambda x: x.isNotNull())))


def lou_list(c: Column) -> Column:
    """Of JSON text, a list or one value: its integers, distinct and sorted. Null, blank text and a list without any give an empty array."""
    listed = F.startswith(strip(c), F.lit("["))
    values = F.when(listed, F.from_json(F.when(listed, c), "array<string>")).otherwise(F.array(c))
    return F.coalesce(int_list(values), F.array().cast("array<bigint>"))


def distinct_by(values: Column, norm) -> Column:
    """The first of the values that share a normal form, in order; those with an empty one are left out."""
    empty = F.array().cast("array<struct<n:string,v:string>>")

    def step(done: Column, v: Column) -> Column:
        n = norm(v)
        known = F.exists(done, lambda x: x["n"] == n)
        return F.when((n == "") | n.isNull() | known, done).otherwise(F.concat(done, F.array(F.struct(n.alias("n"), v.alias("v")))))

    return F.transform(F.aggregate(values, empty, step), lambda x: x["v"])


def without_prefixes(values: Column) -> Column:
    """Leaves out a value that another value is but for an opening bracket and more."""
    return F.filter(values, lambda v: ~F.exists(values, lambda o: (o != v) & (F.startswith(o, F.concat(v, F.lit("("))) | F.startswith(o, F.concat(v, F.lit("（"))))))


def json_object(c: Column) -> Column:
    """Text of the JSON object in a reply: code fence taken off, else from the first brace to the last; null where there is none."""
    bare = strip(F.regexp_replace(strip(c), r"(?is)\A```(?:json)?\s*|\s*```\z", ""))
    whole_text = F.when(F.startswith(bare, F.lit("{")) & F.try_parse_json(bare).isNotNull(), bare)
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(whole_text, F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def cell(c: Column) -> Column:
    return cell_text(F.coalesce(c.cast("string"), F.lit("")))
