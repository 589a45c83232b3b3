"""Training-data pipeline over `documents`: toxicity, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages but the last return
the columns of documents. Rows of any column null, empty texts and repeated rows go
through as the operators' docstrings say; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from postloom.llm.store import keep, shared_folder

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; empty and null texts stay, repeated rows are judged alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(spark, docs, labels).where(F.col("toxicity") < TOXIC).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go out of the texts and n_chars follows; no document goes."""
    out = line_dedup.dedup_lines(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of smallest doc_id. Rows of one doc_id are one document, of which the least row stays; rows without an id all stay."""
    found = near_dedup.near_duplicates(spark, docs, width=5, percent=80)
    ids = found.where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(ids.hint("merge"), "doc_id", "left_semi")
    named = named.groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in docs.columns if c != "text"])).alias("x")).select("x.*")
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes n times is n rows; one without words, or whose source is over its target, may be none."""
    out = mixing.mix_sources(spark, docs).where("mix_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "mix_copies"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to; null and empty texts have no ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.bpe_encode(docs, path, decoded="decoded")
    return out.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("near_dedup", drop_near_copies), ("mixing", mix), ("bpe", encode)]

#: The classifier, the signatures and the automaton have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
