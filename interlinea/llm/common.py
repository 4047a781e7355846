"""Helpers of the corpus operators: column expressions, shared-folder tables, grouped streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- column expressions


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))


def indexes(n: Column) -> Column:
    """0 to n - 1; empty for n = 0 (sequence() would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# ---------------------------------------------------------------- tables in the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own, as
    in tests; on a cluster that would be a folder of one machine, so it is an error there."""
    conf = spark.sparkContext.getConf()
    if named := conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not (own := getattr(shared_dir, "own", None)):
        own = shared_dir.own = f"file://{tempfile.mkdtemp(prefix='interlinea-')}"
    return own


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def stored(df: DataFrame, name: str = "step") -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def sieve(hashes: DataFrame, bits: int = 21) -> Callable[[Column], Column]:
    """A test of long hashes: true for all in the table (h) and, while these are fewer than its bits, for few others.

    It holds 2^bits bits whatever the table, so above that it lets everything through: it saves shuffles and decides nothing."""
    place = lambda h: F.pmod(h, F.lit(1 << bits))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), place(h).bitwiseAND(F.lit(63)).cast("int"))
    word = lambda h: F.call_function("shiftright", place(h), F.lit(6)).cast("int")
    of = [0] * max(1, (1 << bits) // 64)
    for r in hashes.groupBy(word(F.col("h")).alias("w")).agg(F.bit_or(bit(F.col("h"))).alias("m")).collect():
        of[r["w"]] = r["m"]
    held = F.split(F.lit(",".join(map(str, of))), ",").cast("array<bigint>")
    return lambda h: F.get(held, word(h)).bitwiseAND(bit(h)) != 0


# ---------------------------------------------------------------- Arrow streams


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to columns; Spark casts nothing, so schema says the types."""
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def runs(keys: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by their first columns: a group that goes on in the next batch waits."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        start = int(runs(cols)[-2])  # of the last group
        first = [c[0] for c in cols]
        if waiting and (start > 0 or [waiting[-1].column(i)[waiting[-1].num_rows - 1].as_py() for i in range(keys)] != [c.item() if hasattr(c, "item") else c for c in first]):
            if start > 0 and [waiting[-1].column(i)[waiting[-1].num_rows - 1].as_py() for i in range(keys)] == [c.item() if hasattr(c, "item") else c for c in first]:
                yield pa.Table.from_batches([*waiting, batch.slice(0, start)])
            else:
                yield pa.Table.from_batches(waiting)
                if start > 0:
                    yield pa.Table.from_batches([batch.slice(0, start)])
            waiting = [batch.slice(start)]
        elif waiting:
            waiting.append(batch)
        else:
            if start > 0:
                yield pa.Table.from_batches([batch.slice(0, start)])
            waiting = [batch.slice(start)]
    if waiting:
        yield pa.Table.from_batches(waiting)
