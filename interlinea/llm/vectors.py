"""Rows of vectors as integer matrices, for the operators on embeddings; small results of tasks folded into one.

Vectors that are null or hold null or non-finite components are left out. Shorter vectors are padded with zeros to the longest one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema


def finite(vector: Column) -> Column:
    """True for vectors without null, infinite and undefined components; false for null."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def width(vectors: DataFrame, column: str) -> int | None:
    """Components of the longest vector; none for an empty table."""
    return vectors.agg(F.max(F.size(column))).first()[0]


def floors(vectors: pa.Array, size: int, scale: int, limit: int) -> np.ndarray:
    """floor(scale * component) as an integer matrix of that many columns; what goes beyond the limit is held at it."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(values * scale), -limit, limit).astype(np.int64)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(whole) == size * len(vectors) and (lengths == size).all():
        return whole.reshape(len(vectors), size)
    out = np.zeros((len(vectors), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = whole
    return out


def folded(df: DataFrame, fold: Callable[[Iterable[pa.RecordBatch]], dict | None], schema: str, fan: int = 32) -> DataFrame:
    """df's tasks give a row each, and these are folded by so many until one is left: fold(batches of rows) gives a row or nothing."""
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (row := fold(batches)) is not None:
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    n = df.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan)
        df = df.repartition(n).mapInArrow(run, schema)
    return df
