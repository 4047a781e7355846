"""Stages of the corpus pipeline; each is written as Parquet and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of documents. Nulls, empty texts, ties, repeated rows and empty tables are
defined by the operators that the stages call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixture, pieces, quality, simhash, suffix_array
from .common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged, name = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return judged.where(F.col(name)["kept"]).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by sets of five-word shingles with a similarity of 0.8 or more."""
    return simhash.near_copies(docs)


def suffix_array_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that an earlier place has too; n_chars follows the text."""
    out = suffix_array.dedup(docs)
    chars = F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", chars).select(*docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each copy that is taken, in training order."""
    return mixture.mix(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document of the mix."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", suffix_array_stage),
    ("mix_sources", mixture_stage),
    ("sentencepiece", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return docs
