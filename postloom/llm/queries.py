"""One query for each operator, over the whole `documents` or `embeddings` table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.bpe import bpe_encode
from postloom.llm.exact_dedup import exact_dedup, op12_sql
from postloom.llm.hard_negatives import hard_negatives, op11_sql
from postloom.llm.katz import score_texts
from postloom.llm.line_dedup import dedup_lines, op1_sql
from postloom.llm.media import media_columns
from postloom.llm.mixing import mix_sources, op7_sql
from postloom.llm.near_dedup import near_duplicates
from postloom.llm.quality import quality
from postloom.llm.runs import mark_runs
from postloom.llm.sharding import shard
from postloom.llm.suffix_dedup import dedup_substrings
from postloom.llm.toxicity import held_out, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("line_count").cast("long").alias("n_lines"), F.col("line_spread").cast("long").alias("n_spread"), F.col("line_removed").cast("long").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op2_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op3_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op5_column_wise_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark, table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256"))


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))
    out = score_texts(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").withColumns({"size": F.octet_length(text).cast("long") + 16, "text_crc32": F.crc32(text.cast("binary"))})
    out = shard(spark, docs, carry=["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("ring_shard").alias("shard"), F.col("ring_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_tar_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth")


def op11_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", relabelled)
    return hard_negatives(spark, rows, lambda vec_id: vec_id % 100 == 0)


def op12_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark, table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", F.col("copy_keep").alias("keep_id"), F.col("copy_count").alias("group_size"), F.col("copy_kept").alias("kept"), F.col("copy_digest").alias("text_sha256"))


def op13_maximal_pair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mark_runs(spark, table(spark, sf_dir, "documents"), periodic=True, carry=["doc_id"], digests=True)
    exponent = F.expr("1000 * run_length div run_period")
    return out.select("doc_id", F.col("run_count").alias("n_runs"), F.col("run_start").alias("start"), F.col("run_length").alias("length"), F.col("run_period").alias("period"), exponent.alias("exponent_milli"), F.col("runs").alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_site_spread_lines, op2_weak_toxicity, op3_minmax_near_dedup, op4_ngram_ratio_rules, op5_column_wise_bwt, op6_katz_backoff, op7_pareto_mix, op8_bounded_ring, op9_bpe_automaton, op10_tar_media, op11_cover_tree_negatives, op12_heavy_hitter_dedup, op13_maximal_pair_runs)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_site_spread_lines": op1_sql(), "op7_pareto_mix": op7_sql(), "op11_cover_tree_negatives": op11_sql(), "op12_heavy_hitter_dedup": op12_sql()}
