"""Corpus pipeline: language ID, near-dedup, decontamination, redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
A stage's result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import common as C
from tapeloom.llm import decontam, langid, neardup, packing, pii

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null text, no letter."""
    named = langid.identify(docs, C.crc_mod("doc_id", 4) != 2, keep=list(COLUMNS))
    return named.where(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return C.only_ids(docs, C.stored(gone, "gone"), "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share too much with benchmark items."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where("contaminated").select("doc_id").distinct()
    return C.only_ids(docs, C.stored(gone, "gone"), "doc_id", "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and once more what only shows when its neighbours are gone."""
    trees = pii.learn(docs)
    out = pii.redact(pii.redact(docs, trees), trees)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens."""
    return packing.pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", redact), ("packing", pack)]
#: SQL can express neither language ID nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = C.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
