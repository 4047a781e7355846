"""Embedding whitening: components and standard deviations of centred rows by a one-sided Jacobi SVD.

Rows are the distinct integer vectors floor(64 c) + 1000000. Each task centres its rows and compresses them to the triangle R of their QR
decomposition, block by block; triangles of tasks are stacked and compressed in turn, by groups, until one is left (TSQR). R has the
singular values and right singular vectors of all rows, and no covariance is formed, so small deviations keep their accuracy. Plane
rotations then make R's columns orthogonal, many disjoint pairs at a time; their lengths are the singular values, and the rotations gathered
are the components. R is as large as dimensions squared, whatever the number of rows.

How white the result is gets measured over the fit list: means and centred products of tasks are merged by groups, pair by pair.

Defined cases: vectors that are null or hold null or non-finite components are left out; vectors of other lengths are padded with zeros (before
scaling); repeated rows count once in the fit, and each has its rows in the result; ids may repeat and be null; scaled components beyond 2^52 are
held there; fewer dimensions than asked for are as many components; a component without variance (one distinct vector, constant or dependent
dimensions) has explained 0 and a null whitened value, and the identity error covers the others; a deviation that no long can hold is null; an
empty table gives no rows. Only the id and the vector are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, remove, stored, table
from .vectors import finite, floors, folded, width

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
LIMIT = 1 << 52
#: Rows of a block that is compressed at once.
BLOCK = 1 << 12
#: A singular value of this share of the largest one, for each dimension, is rounding.
TINY = 2.0**-48
PRODUCTS = "m long, mean binary, products binary"


@dataclass(frozen=True)
class Whitening:
    """What a fit found. sums are of the integer vectors over the fit list; components are columns, by falling variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total_variance: float
    identity_error: float = 0.0

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: first less its whole part, in integers, then less what is left of it."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Columns of components; those without variance are not a number."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variances > 0, self.centre(x) @ self.components / np.sqrt(self.variances), np.nan)


#: Of vectors without components.
NONE = Whitening(1, (), np.zeros((0, 0)), np.zeros(0), 0.0)


def pack(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, in 32 bits a component where its own values fit, so equal rows are equal bytes."""
    small = ((x >= -(1 << 31)) & (x < 1 << 31)).all(axis=1)
    return [r.astype("<i4").tobytes() if s else r.astype("<i8").tobytes() for r, s in zip(x, small)]


def unpack(column: pa.Array, size: int) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(r) == 4 * size for r in rows):
        return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), size).astype(np.int64)
    return np.stack([np.frombuffer(r, "<i4" if len(r) == 4 * size else "<i8").astype(np.int64) for r in rows])


def fit_list(vectors: DataFrame, size: int, vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(x): each distinct integer vector once, packed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(pack(floors(b.column(0), size, scale, LIMIT) + offset), pa.binary())], ["x"])

    return vectors.select(F.col(vector_col).alias("v")).where(finite(F.col("v"))).mapInArrow(run, "x binary").distinct()


def _sums(size: int) -> Callable:
    schema = arrow_schema("n long, s array<string>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(size, object)
        for b in batches:
            if b.num_rows:
                x = unpack(b.column(0), size)
                n += len(x)
                # Halves of the numbers are summed apart, so that no batch overflows.
                s += (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "s": [str(v) for v in s]}], schema=schema)

    return run


def triangle(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def _triangles(centre: Callable[[np.ndarray], np.ndarray], size: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                r = triangle(r, centre(unpack(b.column(0).slice(i, BLOCK), size)))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    return run


def _stacked(size: int) -> Callable:
    def fold(batches: Iterable[pa.RecordBatch]) -> dict | None:
        r = None
        for b in batches:
            for v in b.column(0).to_pylist():
                r = triangle(r, np.frombuffer(v, np.float64).reshape(-1, size))
        return None if r is None else {"r": r.tobytes()}

    return fold


def _pairings(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which each two of n columns meet once (n even): one stays, the others go round."""
    ring = np.arange(n)
    for _ in range(n - 1):
        yield ring[: n // 2], ring[n // 2 :][::-1]
        ring[1:] = np.roll(ring[1:], 1)


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns: columns are rotated in pairs until all are orthogonal."""
    size = r.shape[1]
    even = size + size % 2
    a = np.zeros((r.shape[0], even))
    a[:, :size] = r
    v = np.eye(even)
    for _ in range(sweeps):
        turned = False
        for p, q in _pairings(even):
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            off = np.abs(gamma) > 1e-15 * np.sqrt(alpha) * np.sqrt(beta)
            if not off.any():
                continue
            turned = True
            p, q, zeta = p[off], q[off], (beta[off] - alpha[off]) / (2 * gamma[off])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    # The column added for evenness never turns; it is the last one of v.
    length = np.sqrt((a[:, :size] ** 2).sum(axis=0))
    order = np.argsort(-length, kind="stable")
    return length[order], v[:size, order]


def _products(model: Whitening, size: int) -> Callable:
    """(m, mean, products): rows, means and centred products of the whitened rows of a task."""
    schema = arrow_schema(PRODUCTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                w = model.whiten(unpack(b.column(0), size))[:, model.variances > 0]
                mean = w.mean(axis=0)
                held = merged(held, (len(w), mean, (w - mean).T @ (w - mean)))
        if held is not None:
            yield pa.RecordBatch.from_pylist([_row(held)], schema=schema)

    return run


def merged(a: tuple | None, b: tuple) -> tuple:
    """Counts, means and centred products of two sets of rows as those of both."""
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * (b[0] / n))


def _row(held: tuple) -> dict:
    return {"m": held[0], "mean": held[1].tobytes(), "products": held[2].tobytes()}


def _merge_rows(batches: Iterable[pa.RecordBatch]) -> dict | None:
    held = None
    for b in batches:
        for r in b.to_pylist():
            mean = np.frombuffer(r["mean"])
            held = merged(held, (r["m"], mean, np.frombuffer(r["products"]).reshape(len(mean), len(mean))))
    return None if held is None else _row(held)


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """The whitening of the distinct integer vectors; none for an empty table. To the driver come sums, R's outcome and one small matrix."""
    spark = vectors.sparkSession
    size = width(vectors.where(finite(F.col(vector_col))), vector_col)
    if size is None:
        return None
    if size == 0:
        return NONE
    once, path = stored(fit_list(vectors, size, vector_col, scale, offset), "fit_list")
    by_task = once.mapInArrow(_sums(size), "n long, s array<string>")
    n = [F.sum("n").alias("n")] + [F.sum(F.get("s", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(size)]
    total = by_task.agg(*n).first()
    model = Whitening(total["n"], tuple(int(total[f"s{j}"]) for j in range(size)), np.zeros((size, 0)), np.zeros(0), 0.0)
    r = folded(once.mapInArrow(_triangles(model.centre, size), "r binary"), _stacked(size), "r binary").first()["r"]
    lengths, vectors_ = jacobi(np.frombuffer(r, np.float64).reshape(-1, size))
    lengths = np.where(lengths > lengths[0] * size * TINY, lengths, 0)
    variances = lengths**2 / model.n
    k = min(components, size)
    model = Whitening(model.n, model.sums, np.ascontiguousarray(vectors_[:, :k]), variances[:k], float(variances.sum()))
    error = 0.0
    if (variances[:k] > 0).any():
        m = folded(once.mapInArrow(_products(model, size), PRODUCTS), _merge_rows, PRODUCTS).first()
        white = int((variances[:k] > 0).sum())
        error = float(np.abs(np.frombuffer(m["products"]).reshape(white, white) / m["m"] - np.eye(white)).max())
    remove(spark, path)
    return Whitening(model.n, model.sums, model.components, model.variances, model.total_variance, error)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n x - s)^2, exact; none where a long can't hold it."""
    most = max((abs(n * int(v) - s) for c, s in zip(x.T, sums) for v in (c.min(), c.max())), default=0)
    if most and len(sums) * most * most < 1 << 63 and n * int(np.abs(x).max()) < 1 << 63 and max(map(abs, sums)) < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", d, d).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in ((d * d).sum(axis=1).tolist() if d.shape[1] else [0] * len(x))]


def whitened(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    size, k = len(model.sums), len(model.variances)
    ddl = f"vec_id {dict(vectors.select(F.col(id_col).alias('i')).dtypes)['i']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = arrow_schema(ddl)
    explained = model.variances / model.total_variance if model.total_variance else np.zeros(k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.num_rows * k
            if not rows:
                continue
            x = floors(b.column(1), size, scale, LIMIT) + offset
            each = pa.array(np.repeat(np.arange(b.num_rows), k))
            w = model.whiten(x).ravel()
            deviation = pa.array(deviations(x, model.n, model.sums), pa.int64()).take(each)
            columns = [b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(rows, model.n)), deviation]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(rows, model.identity_error))], schema=schema)

    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    return rows.where(finite(F.col("v"))).mapInArrow(run, ddl)


def op13_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = fit(vectors)
    return whitened(vectors, model or NONE)
