"""Removal of boilerplate lines by the number of distinct sites that they stand on.

The texts are split once: a kept table has one row for each document with the hashes of its
lines that have words. Sketches, exact counts and hits are read off that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.store import drop, keep, shared_folder

BLANK = " \t\n\x0b\f\r"
MADE = ("line_count", "line_spread", "line_removed")


def words_in(line: Column) -> Column:
    return F.size(F.regexp_extract_all(line, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """Of the lines with words: place among all lines, and 128 bits of the line without outer white space."""
    bare = F.filter(F.transform(lines_of(text), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANK)).alias("x"))), lambda b: b["x"] != "")
    return F.transform(bare, lambda b: F.struct(b["i"].alias("i"), F.xxhash64(b["x"]).alias("h1"), F.xxhash64(F.lit("line"), b["x"]).alias("h2")))


def spread_lines(lines: DataFrame, min_sites: int, folder: str, log2_registers: int = 12) -> DataFrame:
    """(h1, h2) of lines on at least `min_sites` distinct sites. lines: site, keys.

    A HyperLogLog sketch of sites for each line is merged by aggregation. Lines whose
    estimate is within a quarter (and one) of the threshold get exact distinct counts.
    """
    lines = lines.select("site", F.explode("keys").alias("k")).select("site", "k.h1", "k.h2")
    low, high = 0.75 * min_sites - 1, 1.25 * min_sites + 1
    wide = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", log2_registers)).alias("sites"))
    wide = keep(wide.where(F.col("sites") >= low), f"{folder}/wide")
    near = wide.where(F.col("sites") <= high).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"]).distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_sites)
    return keep(wide.where(F.col("sites") > high).select("h1", "h2").union(exact.select("h1", "h2")), f"{folder}/spread")


def dedup_lines(spark: SparkSession, docs: DataFrame, min_sites: int = 8, most_removed: float = 0.5, in_a_row: int = 3) -> DataFrame:
    """docs (text, source, other columns) with cleaned text and line_count, line_spread, line_removed.

    A line (outer white space aside, words required) on at least `min_sites` distinct
    sources is boilerplate; null is a source of its own. It is taken out of every document,
    first one included, except from copies, which are left whole to document deduplication:
    documents whose lines with words are all boilerplate, and those in which boilerplate
    holds more than `most_removed` of the words and `in_a_row` lines with words in
    succession are boilerplate, as only copied passages are.

    Null text stays null, empty text empty; repeated rows stay and are cleaned alike; an
    empty table gives an empty one; no row is dropped. line_spread counts the boilerplate
    lines, line_removed those taken out. Columns of docs with these three names are
    replaced, all others stay.
    """
    folder = shared_folder(spark)
    kept = [c for c in docs.columns if c not in MADE]
    text = F.col("row.text")
    # what is taken from a text depends on the text alone, so equal texts share one row of hits
    keyed = docs.select(F.struct(*kept).alias("row")).withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit("text"), text)})
    site = F.coalesce(F.concat(F.lit("="), F.col("row.source").cast("string")), F.lit("null"))
    lines = keep(keyed.where(text.isNotNull()).select("t1", "t2", site.alias("site"), line_keys(text).alias("keys")), f"{folder}/lines")
    spread = spread_lines(lines, min_sites, folder)
    at = lines.select("t1", "t2", F.size("keys").alias("worded"), F.posexplode("keys").alias("at", "k"))
    hits = at.select("t1", "t2", "worded", "at", "k.*").join(spread, ["h1", "h2"])
    hits = hits.groupBy("t1", "t2").agg(F.max("worded").alias("worded"), F.sort_array(F.collect_set(F.struct("at", "i"))).alias("hits"))
    hits = keep(hits, f"{folder}/hits")
    drop(spark, f"{folder}/lines")

    found = keyed.join(hits, ["t1", "t2"], "left").withColumn("lines", F.when(F.col("hits").isNotNull(), lines_of(text)))
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("hits.i"))
    rest = F.array_join(F.transform(rest, lambda i: F.get("lines", i)), "\n")
    successive = F.exists(F.transform("hits", lambda h, k: F.get("hits", k + F.lit(in_a_row - 1))["at"] - h["at"] == in_a_row - 1), lambda x: F.coalesce(x, F.lit(False)))
    mostly = F.when(successive, words_in(text) - words_in(rest) > F.lit(most_removed) * words_in(text))
    removes = F.col("hits").isNotNull() & (F.size("hits") < F.col("worded")) & ~F.coalesce(mostly, F.lit(False))
    found = found.withColumn("cleaned", F.when(removes, rest))
    size = F.greatest(F.size("hits"), F.lit(0))
    out = {"text": F.coalesce("cleaned", text)}
    return found.select(
        *[out.get(c, F.col("row").getField(c)).alias(c) for c in kept],
        F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("line_count"),
        size.alias("line_spread"),
        F.when(F.col("cleaned").isNotNull(), size).otherwise(0).alias("line_removed"),
    )


def op1_sql(min_sites: int = 8, most_removed: float = 0.5, in_a_row: int = 3) -> str:
    word, blank = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
    return f"""
    with t as materialized (select row_number() over () r, * from documents),
    l as (select r, coalesce('=' || source, 'null') site, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos from t where text is not null),
    b as (select *, regexp_replace(line, '^{blank}|{blank}$', '', 'g') bare, len(regexp_extract_all(line, '{word}')) words from l),
    s as (select bare from b where bare <> '' group by bare having count(distinct site) >= {min_sites}),
    m as (select b.*, s.bare is not null spread from b left join s on b.bare = s.bare),
    w as (select r, sum(spread::int) over (partition by r order by pos rows between {in_a_row - 1} preceding and current row) run from m where words > 0),
    c as (select r, max(run) run from w group by r),
    d as (select r, count(*) n, count(*) filter (spread) n_spread, count(*) filter (words > 0) worded,
        coalesce(sum(words) filter (spread), 0) > {most_removed} * sum(words) mostly,
        coalesce(string_agg(line, chr(10) order by pos) filter (not spread), '') rest from m group by r),
    v as (select d.*, n_spread > 0 and n_spread < worded and not (mostly and c.run >= {in_a_row}) removes from d left join c using (r))
    select doc_id, coalesce(v.n, 0)::bigint n_lines, coalesce(v.n_spread, 0)::bigint n_spread,
      case when v.removes then v.n_spread else 0 end::bigint n_removed,
      sha256(case when v.removes then v.rest else text end) text_sha256
    from t left join v using (r)"""
