"""Incremental ingestion: new document files as a stream, and tables of what is new or changed only.

A document's fingerprint covers its html, its row of parameters and its abbreviations. A batch extracts the documents whose fingerprint isn't that
of their last batch, and writes each table as its own part (`table/batch=n`), then the fingerprints (`_state/batch=n`), which make it count. A
batch that is run again, after a failure or because the stream replays it, sees the state of the batches before it only, so it finds the same
documents and writes the same parts over. Readers take a document's rows from the last batch that has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import hadoop_path

STATE = "_state"


def stream_documents(spark: SparkSession, path: str, pattern: str = "*_body_*.htm*") -> DataFrame:
    """grammars(doc_id, html) as a stream over the files of a folder."""
    files = spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", pattern).format("text").load(path)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.html?$", "").alias("doc_id"), F.regexp_replace("value", "^\ufeff", "").alias("html"))


def process_new(docs: DataFrame, checkpoint: str, process: Callable[[DataFrame, int], None]) -> None:
    """Runs process(batch, number) over what has come since the last run, then stops; files done before aren't read again."""
    query = docs.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# ---------------------------------------------------------------- what has changed


def _told(*values: Column) -> Column:
    """A string that tells values apart, nulls and borders included."""
    return F.to_json(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]), {"ignoreNullFields": "false"})


def fingerprints(docs: DataFrame, params: DataFrame | None = None, abbreviations: DataFrame | None = None) -> DataFrame:
    """docs with print: a digest of all that a document's tables are made from."""
    d = docs.withColumn("of_html", F.sha2(F.coalesce(F.concat(F.lit("h"), F.col("html").cast("string")), F.lit("")).cast("binary"), 256))
    parts = [F.col("of_html")]
    if params is not None:
        columns = sorted(c for c in params.columns if c != "doc_id")
        d = d.join(params.select(F.col("doc_id").alias("p_doc"), _told(*[F.col(c).cast("string") for c in columns]).alias("of_params")), F.col("doc_id").eqNullSafe(F.col("p_doc")), "left").drop("p_doc")
        parts.append(F.col("of_params"))
    if abbreviations is not None:
        listed = abbreviations.groupBy(F.col("doc_id").alias("a_doc")).agg(F.to_json(F.sort_array(F.collect_set("abbr"))).alias("of_abbreviations"))
        d = d.join(listed, F.col("doc_id").eqNullSafe(F.col("a_doc")), "left").drop("a_doc")
        parts.append(F.col("of_abbreviations"))
    return d.withColumn("print", F.sha2(_told(*parts).cast("binary"), 256)).drop("of_html", "of_params", "of_abbreviations")


class Increments:
    """Tables in a folder that are brought up to date batch by batch.

    make(docs) gives the tables, by name, of some documents; each has doc_id. Documents of one batch have ids of their own (of repeated ids
    in one batch, the one of the greatest fingerprint counts)."""

    def __init__(self, spark: SparkSession, folder: str, make: Callable[[DataFrame], dict[str, DataFrame]], params: DataFrame | None = None, abbreviations: DataFrame | None = None) -> None:
        self.spark, self.folder, self.make, self.params, self.abbreviations = spark, folder.rstrip("/"), make, params, abbreviations

    def _there(self, path: str) -> bool:
        fs, p = hadoop_path(self.spark, path)
        return fs.exists(p)

    def _last(self, before: int | None = None) -> DataFrame | None:
        """(doc_id, print, batch): the last batch of each document, of those before a number."""
        if not self._there(f"{self.folder}/{STATE}"):
            return None
        state = self.spark.read.option("basePath", f"{self.folder}/{STATE}").parquet(f"{self.folder}/{STATE}")
        state = state if before is None else state.where(F.col("batch") < before)
        return state.groupBy("doc_id").agg(F.max_by("print", "batch").alias("print"), F.max("batch").cast("long").alias("batch"))

    def changed(self, docs: DataFrame, batch: int) -> DataFrame:
        """docs(doc_id, html, print) that are new or not as they were in the batches before."""
        now = fingerprints(docs, self.params, self.abbreviations)
        now = now.groupBy("doc_id").agg(F.max(F.struct("print", "html")).alias("d")).select("doc_id", "d.html", "d.print")
        last = self._last(batch)
        if last is None:
            return now
        seen = last.select(F.col("doc_id").alias("s_doc"), F.col("print").alias("s_print"))
        return now.join(seen, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("print") == F.col("s_print")), "left_anti")

    def process(self, docs: DataFrame, batch: int) -> None:
        """One batch, as foreachBatch calls it; running it again writes the same."""
        part = f"{self.folder}/_changed/batch={batch}"
        self.changed(docs, batch).write.mode("overwrite").parquet(part)
        changed = self.spark.read.parquet(part)
        for name, table in self.make(changed.select("doc_id", "html")).items():
            table.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
        changed.select("doc_id", "print").write.mode("overwrite").parquet(f"{self.folder}/{STATE}/batch={batch}")
        fs, p = hadoop_path(self.spark, part)
        fs.delete(p, True)

    def table(self, name: str) -> DataFrame:
        """A table as a full run over the last version of every document gives it."""
        last = self._last()
        if last is None:
            raise ValueError("no batch has been processed")
        rows = self.spark.read.option("basePath", f"{self.folder}/{name}").option("mergeSchema", True).parquet(f"{self.folder}/{name}")
        of = last.select(F.col("doc_id").alias("l_doc"), F.col("batch").alias("l_batch"))
        return rows.join(of, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("batch") == F.col("l_batch"))).drop("l_doc", "l_batch", "batch")
