"""Substring dedup by prefix-partitioned suffix trees.

The suffixes of all texts are split into groups by a part of their first words, of variable length: first by the anchor among
their first LENGTH words (see passages), so that suffixes that agree in these meet in one group whatever stands before. A group above the
bound has its prefixes lengthened, to a fifth, a half and at last to all LENGTH words, until its groups fit into memory.
Each group gets a suffix tree, built from its sorted suffixes, which go on to the end of their context, and the lengths that
neighbours have in common. Its internal nodes of depth LENGTH or more are repeats that can't go on to the right in all their places;
with different words, or none, before them they are maximal. The leaves below these nodes are the repeated places. A leaf that
stands for several places is such a node itself, and so is a group of which all suffixes are the same.

A word is removed if it is covered by a window of LENGTH consecutive words of its document whose word sequence also
starts anywhere else, in any document. Windows are judged on the input. passages.spans() gives the passages themselves.

Defined cases: null text is empty and loses nothing; texts of fewer than LENGTH words lose nothing; very long texts are cut into
words whole, one at a time; rows that are repeated are places of their own, so their windows are repeated, and no order of places
matters; null ids are allowed; an empty table gives no rows. Only the id and the text columns are read, so others may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import passages
from .common import table
from .passages import Contexts

LENGTH, GRAM = 35, 8


def nodes(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """Internal nodes (depth, first leaf, last leaf) of the tree over sorted suffixes; lcp[i] is shared by leaves i, i + 1."""
    out, stack = [], []
    for i, depth in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            out.append((d, first, i))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


def deep_leaves(lcp: np.ndarray, depth: int) -> np.ndarray:
    """Which leaves lie below an internal node of at least that depth."""
    under = np.zeros(len(lcp) + 1, bool)
    for d, first, last in nodes(lcp):
        if d >= depth:
            under[first : last + 1] = True
    return under


def tree(c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of at least the least length of all contexts: owner and start of each, their order, and what neighbours share."""
    owner = np.repeat(np.arange(len(c.n)), c.n)
    which = np.concatenate([np.arange(n) for n in c.n])
    size = np.array([len(w) for w in c.words])
    flat = np.concatenate([*c.words, np.zeros(1, np.int32)])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])[owner] + which
    keyed = np.zeros((len(owner), int((size[owner] - which).max()) + 1), ">i4")  # the group, then words from 1; 0 ends a suffix
    keyed[:, 0] = c.group[owner]
    for k in range(1, keyed.shape[1]):
        keyed[:, k] = np.where(which + k <= size[owner], flat[np.minimum(start + k - 1, len(flat) - 1)] + 1, 0)
    order = np.argsort(keyed.view(f"S{4 * keyed.shape[1]}").ravel(), kind="stable")
    a, b = keyed[order[1:]], keyed[order[:-1]]
    differ = (a != b) | (a == 0)  # an end agrees with nothing
    differ[:, 0] = a[:, 0] != b[:, 0]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), keyed.shape[1])
    return owner, which, order, np.maximum(0, first - 1)


def maximal_repeats(c: Contexts) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """The maximal repeats of the tree's deep internal nodes: the words, and the places (context, start) where they stand."""
    owner, which, order, lcp = tree(c)
    out = []
    for depth, first, last in nodes(lcp):
        at = order[first : last + 1]
        before = {int(c.words[owner[i]][which[i] - 1]) if which[i] else -1 - int(i) for i in at}
        if depth >= c.length and len(before) > 1:
            i = at[0]
            out.append((c.words[owner[i]][which[i] : which[i] + depth], sorted((int(owner[i]), int(which[i])) for i in at)))
    return out


def decide(c: Contexts) -> np.ndarray:
    """For each context a bit for each window: whether its words are found at another place."""
    owner, which, order, lcp = tree(c)
    hit = np.zeros(len(owner), bool)
    hit[order] = deep_leaves(lcp, c.length)
    hit |= c.places[owner] > 1
    mask = np.zeros(len(c.n), np.int64)
    np.bitwise_or.at(mask, owner[hit], np.int64(1) << which[hit])
    return mask


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = passages.BLOCK) -> DataFrame:
    """(doc_id, t, m): where each document's repeated windows start; see passages.marks."""
    return passages.marks(docs, length, gram, decide, False, id_col, text_col, block)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return passages.digest(docs, repeated(docs), LENGTH)


def window_sql(length: int, removed: str) -> str:
    """SQL for removal by windows; removed: the condition on a window's row in places."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
windows AS (
  SELECT r, doc_id, i, ws[i] AS word,
         CASE WHEN i + {length - 1} <= len(ws) THEN array_to_string(ws[i:i + {length - 1}], ' ') END AS win
  FROM w),
places AS (SELECT r, doc_id, i, word, win, count(*) OVER (PARTITION BY win) AS n, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM windows),
flags AS (
  SELECT r, i, word, max(CASE WHEN win IS NOT NULL AND {removed} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM places),
kept AS (SELECT r, sum(gone) AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS text FROM flags GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.r = k.r
"""


OP4_SQL = window_sql(LENGTH, "n > 1")
