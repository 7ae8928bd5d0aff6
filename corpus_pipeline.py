"""Corpus pipeline: documents through five operators, each stage written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm import linededup, mixing, simhash, toxicity
from marketspark.llm.bpe import digests
from marketspark.llm.common import read, staged
from marketspark.llm.queries import TOXIC_FROM, codec


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below the threshold stay; learned from this stage's own documents and ``labels``."""
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), model) < TOXIC_FROM)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of 50 words or more leave the texts; all rows stay, ``n_chars`` follows."""
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("_ld_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays: 4-word shingles, at most 4 bits."""
    return simhash.keep_one(docs, distance=4, shingle=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix by weights 3, 1, 2 of 150% of all words takes it."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, with digests of the ids and of what they decode to."""
    return digests(docs, codec(spark), keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("simhash near-dedup", near_dedup),
          ("source mixing", mix_sources), ("byte-level BPE", tokenize)]

#: Scoring, SimHash and tokenization cannot be stated in SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` in order."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage{k}")
    return docs
