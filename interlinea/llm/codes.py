"""Vector code compression: each of 16 parts of a vector becomes the number of its nearest codebook entry.

A part position's entries stand in a vantage-point tree. A node holds an entry and two halves of the others, the nearer and the farther
ones, each with the least and greatest distance to it, rounded down and up to integers. A search measures squared distances in integers,
goes down to the likeliest leaf first, and then visits each half that may hold an entry as near as the best so far or nearer (so that
ties go to the lower number). Rounded bounds only let more halves be visited; what is chosen is decided by exact squared distances.

The codebooks are the only state: 16 x 64 entries, whatever the number of vectors. A round is one pass that sends a row for each used
entry from each task, summed before and after the shuffle.

Defined cases: vectors that are null or hold null or non-finite components are left out; fewer than 64 vectors are as many entries; ids
may repeat and be null (null ids come last among the first entries; equal ids are ordered by their vectors), and each row has a code; null
labels are one label; vectors of other lengths are padded with zeros, to a multiple of 16 components; components beyond 2^26 in absolute
value, after scaling, are held there; an empty table gives no rows. Only the three named columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, stored, table
from .vectors import finite, floors, width

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components are held within this, so that squared distances of parts fit 64 bits.
LIMIT = 1 << 26
#: Entries of a leaf.
LEAF = 6
NONE = np.iinfo(np.int64).max


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer square roots, rounded down and up."""
    low = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    low -= low * low > squares
    low += (low + 1) * (low + 1) <= squares
    return low, low + (low * low < squares)


class Tree:
    """Vantage-point tree over entries (rows of integers); equal entries stand for the first of them."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF) -> None:
        self.entries, self.leaf = entries, leaf
        self.root = self._build(np.sort(np.unique(entries, axis=0, return_index=True)[1]))
        self.measured = 0

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        top, rest = at[0], at[1:]
        d = squared(self.entries[rest], self.entries[top])
        order = np.argsort(d, kind="stable")
        halves = []
        for half in np.array_split(order, 2):
            (low, _), (_, high) = roots(d[half].min()), roots(d[half].max())
            halves.append((int(low), int(high), self._build(np.sort(rest[half]))))
        return top, halves

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q, the number of its nearest entry, the lower one of equally near ones, and the squared distance."""
        best, at = np.full(len(q), NONE), np.zeros(len(q), np.int64)
        rows = np.arange(len(q))
        self._descend(self.root, q, rows, best, at)
        self._search(self.root, q, rows, best, at)
        return at, best

    def _hold(self, rows: np.ndarray, d: np.ndarray, which: np.ndarray | int, best: np.ndarray, at: np.ndarray) -> None:
        better = (d < best[rows]) | ((d == best[rows]) & (which < at[rows]))
        best[rows[better]] = d[better]
        at[rows[better]] = which[better] if isinstance(which, np.ndarray) else which

    def _measure(self, leaf: np.ndarray, q: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        d = squared(q[rows][:, None], self.entries[leaf][None])
        self.measured += d.size
        first = d.argmin(axis=1)
        self._hold(rows, d[np.arange(len(rows)), first], leaf[first], best, at)

    def _descend(self, node, q: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        while len(rows):
            if isinstance(node, np.ndarray):
                return self._measure(node, q, rows, best, at)
            top, ((_, near_high, near), (far_low, _, far)) = node
            d = squared(q[rows], self.entries[top])
            inner = roots(d)[0] * 2 <= near_high + far_low
            self._descend(near, q, rows[inner], best, at)
            node, rows = far, rows[~inner]

    def _search(self, node, q: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            return self._measure(node, q, rows, best, at)
        top, halves = node
        d = squared(q[rows], self.entries[top])
        self.measured += len(rows)
        self._hold(rows, d, int(top), best, at)
        low, high = roots(d)
        for least, most, half in halves:
            bound = np.maximum(np.maximum(low - most, least - high), 0)
            may = bound * bound <= best[rows]
            if may.any():
                self._search(half, q, rows[may], best, at)


def assigned(x: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the nearest entries by part, and squared distances summed over parts."""
    d = x.shape[1] // len(trees)
    found = [t.nearest(np.ascontiguousarray(x[:, p * d : (p + 1) * d])) for p, t in enumerate(trees)]
    return np.stack([at for at, _ in found], axis=1), np.sum([e for _, e in found], axis=0)


def _sums(books: np.ndarray, scale: int) -> Callable:
    """(part, entry, n, s): how many parts are nearest to an entry, and their sums, a row for each used entry of a task."""
    parts, entries, d = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
        for b in batches:
            if b.num_rows:
                x = floors(b.column(0), parts * d, scale, LIMIT)
                at, _ = assigned(x, trees)
                for p in range(parts):
                    n[p] += np.bincount(at[:, p], minlength=entries)
                    for j in range(d):
                        # Exact: 2^26 times the rows of a batch stays below 2^53.
                        s[p, :, j] += np.bincount(at[:, p], weights=x[:, p * d + j], minlength=entries).astype(np.int64)
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(s[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    return run


def codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Entries by part, (parts, entries, components), after so many rounds from the vectors of the least ids; none for an empty table."""
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(finite(F.col("v")))
    if (longest := width(kept, "v")) is None:
        return None
    d = max(1, -(-longest // parts))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    x = floors(pa.array([r["v"] for r in first], pa.list_(pa.float64())), parts * d, scale, LIMIT)
    books = np.ascontiguousarray(x.reshape(len(first), parts, d).transpose(1, 0, 2))
    for _ in range(rounds):
        sums = kept.select("v").mapInArrow(_sums(books, scale), "part int, entry int, n long, s array<long>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(d)])
        books = books.copy()
        for r in total.collect():  # a row for each entry at most
            books[r["part"], r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(d)]
    return books


def encoded(vectors: DataFrame, books: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part, and the squared distance to what the code stands for."""
    parts, _, d = books.shape
    kinds = dict(vectors.select(F.col(id_col).alias("i"), F.col(label_col).alias("l")).dtypes)
    ddl = f"vec_id {kinds['i']}, label {kinds['l']}, code string, error long"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        for b in batches:
            if b.num_rows:
                at, error = assigned(floors(b.column(2), parts * d, scale, LIMIT), trees)
                digits = at.astype(np.uint8).tobytes().hex()
                code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code), pa.array(error)], schema=schema)

    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    return rows.where(finite(F.col("v"))).mapInArrow(run, ddl)


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): what the codes stand for, the middle of each scaled step, as doubles."""
    parts, _, _ = books.shape
    ddl = f"vec_id {dict(codes.dtypes)['vec_id']}, vector array<double>"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([list(bytes.fromhex(c)) for c in b.column(1).to_pylist()], np.int64).reshape(b.num_rows, parts)
            x = (books[np.arange(parts), at].reshape(b.num_rows, -1) + 0.5) / scale
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], schema=schema)

    return codes.select("vec_id", "code").mapInArrow(run, ddl)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal integers with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error: errors summed over equal labels, nulls together. Sums meet in partial aggregates; a large label's rows
    are dealt out by the join's skew handling, not gathered."""
    of = codes.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error"))
    return codes.join(of, F.col("label").eqNullSafe(F.col("label_")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = codebooks(vectors)
    if books is None:
        return vectors.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes, _ = stored(encoded(vectors, books), "codes")
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql_round(n: int) -> str:
    """The n-th assignment a{n} to the entries e{n}, and the entries e{n+1} made of it."""
    return f"""
d{n} AS (SELECT vec_id, c.p, e.e, sum((c.x - e.x) * (c.x - e.x)) AS d2 FROM comps c JOIN e{n} e ON c.p = e.p AND c.j = e.j GROUP BY ALL),
a{n} AS (SELECT vec_id, p, e, d2 FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d2, e) = 1),
t{n} AS (SELECT c.p, a.e, c.j, CAST(sum(c.x) AS BIGINT) AS s, count(*) AS n FROM comps c JOIN a{n} a ON a.vec_id = c.vec_id AND a.p = c.p GROUP BY ALL),
e{n + 1} AS (SELECT e.p, e.e, e.j, coalesce((t.s - ((t.s % t.n) + t.n) % t.n) // t.n, e.x) AS x FROM e{n} e LEFT JOIN t{n} t ON t.p = e.p AND t.e = e.e AND t.j = e.j)"""


OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, embedding, len(embedding) // 16 AS d FROM embeddings e
  WHERE embedding IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(e.embedding) AS c) WHERE c IS NULL OR isnan(c) OR isinf(c))),
each AS (SELECT vec_id, d, unnest(embedding) AS c, generate_subscripts(embedding, 1) - 1 AS i FROM kept),
comps AS (SELECT vec_id, i // d AS p, i % d AS j, CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT) AS x FROM each),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
e0 AS (SELECT p, e, j, x FROM comps JOIN firsts USING (vec_id)),{_sql_round(0)},{_sql_round(1)},{_sql_round(2)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d2) AS BIGINT) AS error
  FROM a2 JOIN kept USING (vec_id) GROUP BY vec_id, label),
book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM e2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book
"""
