"""The corpus pipeline: four or five operators one after the other over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from interlinea.llm import pipeline

STAGES = pipeline.STAGES
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(spark, sf_dir)
