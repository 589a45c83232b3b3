"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.store import keep, set_aside, shared_folder

WORDS = r"[^\x20\x09-\x0D]+"
CELLS = 4096
MADE = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))).cast("long")


def random_odds(seed: int) -> Column:
    """u / (1 - u) of a uniform u that the document's id decides; of its text where the id is null. 52 bits, so that any engine with md5 agrees."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), name)), 1, 13), 16, 10).cast("double") + 0.5) / 4503599627370496.0
    return u / (1 - u)


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """Adds mix_size (words), mix_group (the source, null made a value of its own) and mix_rank: random odds over inclusion odds, put into 0 to 1.

    Inclusion odds are those of the source's fraction times the square root of the size
    plus one, so longer documents are likelier; the fraction is the same for all of a
    source and leaves their order as it is.
    """
    docs = docs.withColumn("mix_size", n_words(F.col("text")))
    q = random_odds(seed) / F.sqrt(F.col("mix_size") + 1)
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    return docs.withColumns({"mix_group": group, "mix_rank": q / (1 + q)})


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds mix_target: `share` of all words, divided by weight; no source above `most` times its size, the rest reshared.

    The table has one row for each source. Sources reach their bound in the order of bound
    over weight. Running sums in that order give a level for each row, as if all before it
    were bounded; of those that a row can bear, the greatest is the right one.
    """
    by_name = Window.orderBy(F.col("mix_group") == "null", "mix_group")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    out = sources.withColumn("w", w).withColumn("bound", F.col("mix_source_size") * float(most))
    order = Window.orderBy(F.col("bound") / F.col("w"), "mix_group")
    all_rows = Window.partitionBy()
    before = F.coalesce(F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.withColumn("level", (F.sum("mix_source_size").over(all_rows) * float(share) - before) / rest)
    out = out.withColumn("level", F.max(F.when(F.col("bound") >= F.col("level") * F.col("w"), F.col("level"))).over(all_rows))
    return out.withColumn("mix_target", F.least("bound", F.coalesce(F.col("level") * F.col("w"), "bound"))).drop("w", "bound", "level")


def _cell(cells: DataFrame, need: str) -> DataFrame:
    """Of each source's cells in order, the one in which running words reach the need, and the words before it."""
    run = Window.partitionBy("mix_group").orderBy("cell")
    upto = F.sum("words").over(run)
    found = cells.withColumn("upto", upto).where(F.col("upto") > F.col(need))
    return found.groupBy("mix_group").agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"))).alias("x")).select("mix_group", "x.cell", "x.before")


def cuts(spark: SparkSession, rows: DataFrame, weights: Sequence[float], share: float, most: float, folder: str) -> DataFrame:
    """One row for each source: size, target, whole copies of every document, and the rank up to which one copy more is taken.

    A source's ranks are counted in 4096 cells, the cell that holds the cut in 4096 again,
    and only what is in that cell is put in order, so no source is sorted in one task.
    """
    sources = rows.groupBy("mix_group").agg(F.sum("mix_size").alias("mix_source_size"))
    plan = targets(sources, weights, share, most)
    whole = F.when(F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))).otherwise(0)
    plan = plan.withColumn("mix_whole", whole.cast("int")).withColumn("need", F.col("mix_target") - F.col("mix_whole") * F.col("mix_source_size"))
    plan = keep(plan, f"{folder}/plan")
    first = rows.groupBy("mix_group", F.floor(F.col("mix_rank") * CELLS).alias("cell")).agg(F.sum("mix_size").alias("words"))
    first = keep(_cell(first.join(plan.select("mix_group", "need"), "mix_group"), "need"), f"{folder}/first")
    inside = rows.join(first, "mix_group").where(F.floor(F.col("mix_rank") * CELLS) == F.col("cell"))
    second = inside.groupBy("mix_group", "before", F.floor(F.col("mix_rank") * CELLS * CELLS).alias("cell")).agg(F.sum("mix_size").alias("words"))
    second = second.join(plan.select("mix_group", "need"), "mix_group").withColumn("need", F.col("need") - F.col("before"))
    second = keep(_cell(second, "need").join(first.select("mix_group", F.col("before").alias("earlier")), "mix_group").withColumn("before", F.col("before") + F.col("earlier")).drop("earlier"), f"{folder}/second")
    last = rows.join(second, "mix_group").where(F.floor(F.col("mix_rank") * CELLS * CELLS) == F.col("cell"))
    last = last.groupBy("mix_group", "before", "mix_rank").agg(F.sum("mix_size").alias("words")).join(plan.select("mix_group", "need"), "mix_group")
    run = Window.partitionBy("mix_group").orderBy("mix_rank")
    last = last.withColumn("off", F.abs(F.col("before") + F.sum("words").over(run) - F.col("need")))
    # the rank whose inclusion brings the words nearest to the need; none of the cell if that is nearer still
    last = last.groupBy("mix_group").agg(F.min(F.struct("off", "mix_rank")).alias("x"), F.first("before").alias("before"), F.first("need").alias("need"))
    last = last.select("mix_group", F.when(F.col("x.off") < F.abs(F.col("need") - F.col("before")), F.col("x.mix_rank")).alias("cut"))
    out = plan.join(second.select("mix_group", (F.col("cell") / F.lit(float(CELLS * CELLS))).alias("below")), "mix_group", "left").join(last, "mix_group", "left")
    return keep(out.drop("need"), f"{folder}/cuts")


def mix_sources(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = 11) -> DataFrame:
    """docs (doc_id, text, source, other columns) with mix_size, mix_source_size, mix_target and mix_copies.

    Sources by code point, null last, take the weights in turn. Each source's target is met
    by certain whole copies of every document, then by a fixed-size Pareto order sample:
    documents ranked by random odds divided by inclusion odds are taken until the words
    come nearest to what is left. Null text or text without words has size 0. Rows of equal
    id (and equal text where the id is null) share their rank and are taken together. A
    source without words has target 0. An empty table gives an empty one. Columns of docs
    with these four names are replaced, all others stay.
    """
    folder = shared_folder(spark)
    docs, taken = set_aside(docs, ("doc_id", "text", "source"), MADE)
    rows = sized(docs, seed)
    facts = keep(rows.select("mix_group", "mix_size", "mix_rank"), f"{folder}/facts")
    plan = cuts(spark, facts, weights, share, most, folder)
    out = rows.join(plan, "mix_group")
    extra = F.coalesce(F.col("mix_rank") < F.col("below"), F.lit(False)) | F.coalesce(F.col("mix_rank") <= F.col("cut"), F.lit(False))
    return out.withColumn("mix_copies", F.col("mix_whole") + extra.cast("int")).select(*taken, *MADE)


def op7_sql(weights: Sequence[float] = (1, 2, 3), seed: int = 11) -> str:
    """DuckDB SQL for the query's rows: the same sample by plain sorting."""
    cycle = " ".join(f"when {k} then {float(w)}" for k, w in enumerate(weights))
    return f"""
    with d as (
      select doc_id, coalesce('=' || source, 'null') g, cast(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) as bigint) size,
        (cast('0x' || substr(md5('{seed}|' || coalesce(cast(doc_id as varchar), md5(coalesce(text, '')))), 1, 13) as bigint)::double + 0.5) / 4503599627370496.0 u
      from documents),
    q as (select *, u / (1 - u) / sqrt(size + 1) odds from d),
    r as (select *, odds / (1 + odds) rank from q),
    s as (select g, sum(size)::bigint source_size from r group by g),
    w as (select *, case (row_number() over (order by g = 'null', g) - 1) % {len(weights)} {cycle} end w, source_size * 3.0::double bound from s),
    l as (select *, ((sum(source_size) over ())::double - coalesce(sum(bound) over (order by bound / w, g rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by bound / w, g rows between current row and unbounded following) lv from w),
    m as (select *, max(case when bound >= lv * w then lv end) over () level from l),
    t as (select g, source_size, least(bound, coalesce(level * w, bound)) target from m),
    n as (select *, case when source_size > 0 then floor(target / source_size) else 0 end whole, target - case when source_size > 0 then floor(target / source_size) else 0 end * source_size need from t),
    c as (select r.*, n.* exclude (g), sum(size) over (partition by r.g order by rank) upto from r join n using (g)),
    o as (select g, arg_min(rank, abs(upto - need)) cut, min(abs(upto - need)) off, any_value(need) need from (select * from c order by g, rank) group by g)
    select doc_id, size, source_size, target, cast(size * (whole + case when o.off < o.need and rank <= o.cut then 1 else 0 end) as bigint) taken from c join o using (g)"""
