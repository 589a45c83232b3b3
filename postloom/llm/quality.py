"""Quality rules and a hashed n-gram log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.store import keep, set_aside, shared_folder

WORDS = r"[^\x20\x09-\x0D]+"
#: Ratios are whole millionths, so that sums are exact and a verdict never depends on their order.
MICRO = 1_000_000
SYMBOLS = "[#*$%&|<>]"


def with_words(docs: DataFrame) -> DataFrame:
    """Adds _text (null made empty) and _w, its words."""
    docs = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    return docs.withColumn("_w", F.regexp_extract_all("_text", F.lit(WORDS), F.lit(0)))


def with_base(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to what with_words gives.

    Words of repeated windows are counted inside the row: the windows' hashes are sorted
    with their places, those equal to a neighbour are kept, and each kept place covers
    three words or as many as lie before the next.
    """
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    out = docs.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
            "_lines": F.filter(F.split("_text", "\n", -1), has_word),
            "_win": F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))),
        }
    )
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    out = out.withColumn("_win", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: (x["h"] == F.get("_win", k - 1)["h"]) | (x["h"] == F.get("_win", k + 1)["h"])
    out = out.withColumn("_rep", F.sort_array(F.transform(F.filter("_win", lambda x, k: same(x, k)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_rep", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_rep", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_lines", "_win", "_rep")


def buckets(words: Column, n: int) -> Column:
    """Hash buckets of the text's words and word pairs; the last word is paired with the end."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int"))
    two = F.transform(words, lambda w, i: F.pmod(F.xxhash64(w, F.lit("+"), F.get(words, i + 1)), F.lit(n)).cast("int"))
    return F.concat(one, two)


def ratio_table(docs: DataFrame, labels: DataFrame, n: int, smoothing: float, folder: str) -> DataFrame:
    """(bucket, ratio, target): log of the n-gram's share in trusted documents over its share in all documents, and how often it is in the trusted ones.

    Counts cover all documents and all trusted ones; whatever the input, the table has n rows.
    """
    trusted = labels.where("quality = 1").select("doc_id").distinct().withColumn("_trusted", F.lit(1))
    # both sides grow with the input, so the join is shuffled at every size
    tagged = with_words(docs.select("doc_id", "text").join(trusted.hint("merge"), "doc_id", "left"))
    grams = tagged.select("_trusted", F.explode(buckets(F.col("_w"), n)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("_trusted").alias("target"), F.count("*").alias("raw"))
    counts = keep(counts, f"{folder}/counts")
    total = counts.agg((F.sum("target") + smoothing * n).alias("t"), (F.sum("raw") + smoothing * n).alias("r"))
    all_buckets = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    row = total.first()
    t, r = (row["t"] or smoothing * n), (row["r"] or smoothing * n)
    share = lambda c, whole: (F.col(c) + smoothing) / F.lit(float(whole))
    ratio = F.round(F.log(share("target", t) / share("raw", r)) * MICRO).cast("long")
    return keep(all_buckets.select("bucket", ratio.alias("ratio"), "target"), f"{folder}/ratios")


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, n: int = 1 << 17, smoothing: float = 0.5, margin: float = 0.15) -> DataFrame:
    """docs (doc_id, text, other columns) with the base counts, base_failed, llr and kept.

    labels: doc_id, quality (1: trusted). llr is the mean log-likelihood ratio of the
    document's hashed words and word pairs under trusted and raw multinomials; a document
    is kept if base rules hold and llr is no more than `margin` below the mean of all trusted
    n-grams. Null or word-free text: llr 0,
    base_failed. With no labels all ratios are near 0 and the base rules decide. Every
    document is scored whole. The ratio table has n rows for any input and is broadcast. Repeated
    rows are judged alike; an empty table gives an empty one. Columns of docs with the made
    names are replaced, all others stay.
    """
    folder = shared_folder(spark)
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    docs, kept = set_aside(docs, ("doc_id", "text"), made)
    table = ratio_table(docs, labels, n, smoothing, folder)
    trusted = table.agg(F.sum(F.col("ratio") * F.col("target")).alias("s"), F.sum("target").alias("n")).first()
    threshold = (trusted["s"] / trusted["n"] / MICRO if trusted["n"] else 0.0) - margin
    table = table.select("bucket", "ratio")
    keys = {"_t1": F.xxhash64("_text"), "_t2": F.xxhash64(F.lit("text"), "_text")}
    # the mean of a text's ratios is that of its copies together, so equal texts are one group
    grams = with_words(docs.select("text")).withColumns(keys).select("_t1", "_t2", F.explode(buckets(F.col("_w"), n)).alias("bucket"))
    means = grams.join(F.broadcast(table), "bucket").groupBy("_t1", "_t2").agg((F.sum("ratio") / F.count("*") / MICRO).alias("llr"))
    scored = with_base(with_words(docs)).withColumns(keys).drop("_text", "_w").join(means, ["_t1", "_t2"], "left")
    scored = scored.withColumn("llr", F.coalesce("llr", F.lit(0.0)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).select(*kept, *made)
