"""Suffix-array dedup with sparse suffix arrays: only suffixes at content-selected minimiser positions are kept.

A minimiser is the leftmost gram of GRAM words with the least hash among those of a window of LENGTH words, so equal
passages of LENGTH words have equal minimisers at equal places (see passages). The suffixes that begin at
minimisers are sorted by their words, neighbours are compared for the length they have in common to the right,
and matches are extended to the left word by word: for each number of words to the left, those that agree in
the words to the left and have enough in common to the right hold the same window.

Of each repeated window one place stays, the first by (id, place); words covered by a later one are removed.

Defined cases: null text is empty and stays; texts of fewer than LENGTH words stay; very long texts are cut into words whole, one
at a time; rows equal in id and text are one document, so neither is a repeat of the other; of places with one id the least
text hash is first; null ids come first; an empty table gives no rows. All columns of the input are carried through dedup(), whatever
their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import passages
from .common import table
from .passages import Contexts
from .suffix_trees import window_sql

LENGTH, GRAM = 50, 10


def sparse_array(group: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (rows of right, ended by negative numbers) inside their groups, and what neighbours share."""
    keyed = np.concatenate([group[:, None], right + 2], axis=1).astype(">i4")
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{4 * keyed.shape[1]}").ravel(), kind="stable")
    a, b = keyed[order[:-1]], keyed[order[1:]]
    same = (a == b) & (a > 0)
    lcp = np.where(same.all(axis=1), right.shape[1], np.maximum(0, same.argmin(axis=1) - 1))
    return order, lcp


def decide(c: Contexts) -> np.ndarray:
    """For each context a bit for each window that an earlier context holds too; contexts come in the order of their places."""
    m, length = len(c.n), c.length
    group = c.group
    wide = max(len(w) - o for w, o in zip(c.words, c.o))
    right, left = np.full((m, wide), -2, np.int32), np.full((m, int(c.o.max()) + 1), -1, np.int32)
    for i, (w, o) in enumerate(zip(c.words, c.o)):
        right[i, : len(w) - o] = w[o:]
        left[i, :o] = w[:o][::-1]
    order, lcp = sparse_array(group, right)
    mask = np.zeros(m, np.int64)
    alike = np.zeros(m, np.int64)  # number of those with the same words to the left, so far
    for k in range(left.shape[1]):  # k words to the left of the minimiser
        if k:
            alike = np.unique(alike * (int(left.max()) + 2) + left[:, k - 1] + 1, return_inverse=True)[1]
        own = (k <= c.o) & (k > c.o - c.n)  # contexts that have a window beginning there
        run = np.zeros(m, np.int64)
        run[order] = np.cumsum(np.append(True, lcp < length - k))  # of suffixes with length - k words in common
        at = np.flatnonzero(own)
        if len(at) > 1:
            _, first, which = np.unique(run[at] * m + alike[at], return_index=True, return_inverse=True)
            later = at[first[which] != np.arange(len(at))]
            mask[later] |= np.int64(1) << (c.o[later] - k)
    return mask


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = passages.BLOCK) -> DataFrame:
    """(doc_id, t, m): where each document's later places of repeated windows start; see passages.marks."""
    return passages.marks(docs, length, gram, decide, True, id_col, text_col, block)


def without(raw: bytes, gone: np.ndarray) -> bytes:
    """The text without the words that are gone and the white space after them."""
    out, at = [], 0
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(raw[at : spans[a][0]])
        at = spans[b][0] if b < len(spans) else len(raw)
    return b"".join([*out, raw[at:]])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated passages cut out of the texts; texts without any are left as they are."""
    found = repeated(docs, id_col, text_col)
    schema = f"row struct<{', '.join(f'`{f.name.replace(chr(96), chr(96) * 2)}`: {f.dataType.simpleString()}' for f in docs.schema)}>, kept string"

    def batch(b: pa.RecordBatch) -> dict:
        texts = []
        for raw, m in zip(b.column(1), b.column(2)):
            text = raw.as_py()
            _, gone = passages.removed(text, m.as_py(), LENGTH) if m.is_valid else (None, None)
            texts.append(text.decode("utf-8", "replace") if gone is None and text is not None else text if text is None else without(text, gone).decode("utf-8", "replace"))
        return {"row": b.column(0), "kept": pa.array(texts, pa.string())}

    out = passages.apply_marks(docs, found, batch, schema, id_col, text_col)
    return out.select(*(F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return passages.digest(docs, repeated(docs), LENGTH)


OP6_SQL = window_sql(LENGTH, "k > 1")
