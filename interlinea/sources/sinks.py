"""Sinks: tab-separated reports, XML, Parquet tables of an extraction, and stages that can be resumed. A file a document: see files.py."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: Orders of the report files; reading them back needs no schema beyond strings.
MORPH_COLUMNS = ["morph", "gloss", "prev_morph", "prev_gloss", "next_morph", "next_gloss", "ex_number"]


def write_tsv(df: DataFrame, path: str, header: bool = True, partition_by: list[str] | None = None) -> None:
    """A report as tab-separated text without quoting."""
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "\x00").option("escapeQuotes", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_xml(df: DataFrame, path: str, row_tag: str, root_tag: str) -> None:
    """A table, nested columns included, as XML files."""
    df.write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)


def write_tables(extraction, folder: str, only: list[str] | None = None) -> list[str]:
    """The tables of an extraction as Parquet, one folder each; the names of those written."""
    tables = [n for n, v in vars(type(extraction)).items() if isinstance(v, cached_property) and not n.startswith("_")]
    names = [n for n in tables if only is None or n in only]
    for name in names:
        getattr(extraction, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    return names


def resumed(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's table: read if it was written to the end before, otherwise made and written. A half-written one is made anew."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
