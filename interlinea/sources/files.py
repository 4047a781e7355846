"""One file a document: a sink whose tasks write under temporary names and publish whole files.

`document_files` takes rows (name, line), the lines of a file side by side and in order, as write_files() deals them. A task writes each
file into a folder of its own attempt and then publishes it by a hard link, which fails if the name is taken: so a file is there whole or
not at all, and of several attempts of a task, or of two jobs, one makes it. With existing = keep, what was there before stays (and is
counted); with replace, a whole file takes its place by a rename. Attempts that fail leave nothing but their folder, which the job removes.

Paths are of file systems that executors see as folders, such as a shared mount; others are refused.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

KEEP, REPLACE = "keep", "replace"
#: Lines of files that a batch holds.
LINES = 4096


def folder_of(path: str) -> str:
    """A path as a folder of the local or a mounted file system."""
    scheme, sep, rest = path.partition("://")
    if sep and scheme != "file":
        raise ValueError(f"no folder that executors can open: {path}")
    return ("/" + rest.lstrip("/")) if sep else path.removeprefix("file:")


@dataclass
class Published(WriterCommitMessage):
    """How many files a task made, and how many were there already."""

    made: int
    there: int
    names: str | None = None


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.folder, self.existing, self.job = folder_of(options["path"]), options.get("existing", KEEP), options["job"]
        if self.existing not in (KEEP, REPLACE):
            raise ValueError(f"existing is {KEEP} or {REPLACE}, not {self.existing}")
        self.attempts, self.listed = os.path.join(self.folder, f"_attempts-{self.job}"), options.get("listed")

    def write(self, rows: Iterator[Row]) -> Published:
        own = os.path.join(self.attempts, uuid.uuid4().hex)
        os.makedirs(own)
        out, name, made, there, names = None, None, 0, 0, None
        if self.listed:
            os.makedirs(folder_of(self.listed), exist_ok=True)
            names = open(os.path.join(folder_of(self.listed), f"_{os.path.basename(own)}"), "w", encoding="utf-8", newline="\n")  # noqa: SIM115

        def publish() -> bool:
            out.close()
            if names:
                names.write(name + "\n")
            target = os.path.join(self.folder, name)
            if self.existing == REPLACE:
                os.replace(out.name, target)
                return True
            try:
                os.link(out.name, target)
            except FileExistsError:
                return False
            return True

        try:
            for row in rows:
                if row[0] != name:
                    if out:
                        done = publish()
                        made, there = made + done, there + (not done)
                    name = row[0]
                    if not name or "/" in name or name.startswith((".", "_")):
                        raise ValueError(f"no name of a file: {name!r}")
                    out = open(os.path.join(own, name), "w", encoding="utf-8", newline="\n")  # noqa: SIM115
                if row[1] is not None:
                    out.write(row[1] + "\n")
            if out:
                done = publish()
                made, there = made + done, there + (not done)
        finally:
            if out:
                out.close()
            if names:
                names.close()
            shutil.rmtree(own, ignore_errors=True)
        return Published(made, there, names and names.name)

    def commit(self, messages: list[Published]) -> None:
        # Lists of attempts that don't count keep the underscore, so they aren't read.
        for m in messages:
            if m and m.names:
                folder, listed = os.path.split(m.names)
                os.replace(m.names, os.path.join(folder, listed.removeprefix("_")))
        shutil.rmtree(self.attempts, ignore_errors=True)
        told = os.path.join(self.folder, f"_job-{self.job}.json")
        with open(told, "w") as f:
            json.dump({"made": sum(m.made for m in messages if m), "there": sum(m.there for m in messages if m)}, f)

    def abort(self, messages: list[Published]) -> None:
        shutil.rmtree(self.attempts, ignore_errors=True)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["string", "string"]:
            raise ValueError("rows are (name string, line string)")
        return FileWriter(dict(self.options))


def write_files(lines: DataFrame, path: str, name: str = "name", line: str = "line", order: list[str] | None = None, existing: str = KEEP, listed: str | None = None) -> dict[str, int]:
    """Writes each name's lines, in order, as a file of the folder; how many files were made, and how many were there already.

    A null line writes nothing, so a file may be empty. Files' rows meet by one shuffle and are streamed, never held. listed: a folder for the names
    of the files, a list a task, from which read_reports() finds them."""
    spark, job = lines.sparkSession, uuid.uuid4().hex
    folder = folder_of(path)
    os.makedirs(folder, exist_ok=True)
    spark.dataSource.register(DocumentFiles)
    dealt = lines.repartition(F.col(name)).sortWithinPartitions(name, *(order or [])).select(F.col(name).alias("name"), F.col(line).alias("line"))
    out = dealt.write.format("document_files").mode("append").option("existing", existing).option("job", job)
    (out.option("listed", listed) if listed else out).save(path)
    told = os.path.join(folder, f"_job-{job}.json")
    with open(told) as f:
        out = json.load(f)
    os.remove(told)
    return out


# ---------------------------------------------------------------- what is written a file a document


def _joined(columns: list[str]) -> F.Column:
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\\t\\n\\r]", " ")
    return F.concat_ws("\t", *[bare(c) for c in columns])


def write_reports(report: DataFrame, path: str, ending: str, columns: list[str], order: list[str], header: bool = False, listed: str | None = None) -> dict[str, int]:
    """A report of all documents as tab-separated files, one a document, without quoting; tabs and line ends in values are spaces."""
    rows = report.select(F.concat(F.col("doc_id").cast("string"), F.lit(ending)).alias("name"), F.lit(1).alias("part"), *order, _joined(columns).alias("line"))
    if header:
        top = rows.select("name").distinct().select("name", F.lit(0).alias("part"), *[F.lit(None).cast(t).alias(c) for c, t in rows.select(*order).dtypes], F.lit("\t".join(columns)).alias("line"))
        rows = rows.unionByName(top)
    return write_files(rows, path, order=["part", *order], existing=REPLACE, listed=listed)


def read_reports(spark: SparkSession, path: str, listed: str, columns: list[str]) -> DataFrame:
    """(name, columns): what reports without a header say, of the files that are listed.

    Spark's own reader would hold each file's status on the driver, which grows with the documents; here tasks open the files that they have names of."""
    folder = folder_of(path)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for name in batch.column(0).to_pylist():
                with open(os.path.join(folder, name), encoding="utf-8", newline="\n") as f:
                    for line in f:
                        names.append(name)
                        texts.append(line.removesuffix("\n"))
                        if len(texts) == LINES:
                            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["name", "line"])
                            names, texts = [], []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["name", "line"])

    names = spark.read.text(listed).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "value")
    parsed = F.from_csv("line", ", ".join(f"{c} string" for c in columns), {"sep": "\t", "quote": ""})
    return names.mapInArrow(lines, "name string, line string").withColumn("r", parsed).select("name", "r.*")


def write_pages(pages: DataFrame, path: str, column: str = "html", ending: str = ".html") -> dict[str, int]:
    """Marked-up pages, one file a document."""
    return write_files(pages.select(F.concat(F.col("doc_id").cast("string"), F.lit(ending)).alias("name"), F.col(column).alias("line")), path, existing=REPLACE)


def write_default_params(docs: DataFrame, template: DataFrame, path: str) -> int:
    """A parameter file from the template(line_no, text) for each document that has none; none is ever overwritten. How many were made."""
    rows = template.agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("rows"))
    names = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("_params.txt")).alias("name")).distinct()
    lines = names.join(F.broadcast(rows), how="cross").select("name", F.inline("rows")).select("name", "line_no", F.col("text").alias("line"))
    return write_files(lines, path, order=["line_no"], existing=KEEP)["made"]
