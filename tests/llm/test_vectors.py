"""Vector codes and whitening, held against numpy on small fixtures."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from interlinea.llm import codes, registry, whitening
from interlinea.llm.vectors import floors

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """By definition, with Python's integers."""
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    cut = [[x[p * d : (p + 1) * d] for p in range(parts)] for _, x, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for c in cut:
                of.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(of[k]) for col in zip(*of[k])] if k in of else e for k, e in enumerate(books[p])]
    out = []
    for (i, _, lab), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, digest


def test_tree_finds_what_a_full_search_finds():
    rng = np.random.default_rng(5)
    for d, spread, n in ((1, 4, 64), (2, 3, 64), (4, 30, 64), (4, 1 << 26, 64), (3, 2, 40), (8, 100, 1), (4, 50, 7)):
        entries = rng.integers(-spread, spread + 1, (n, d))
        entries[n // 2 :: 5] = entries[0]  # entries that are equal
        q = np.concatenate([rng.integers(-spread, spread + 1, (500, d)), entries])
        every = ((q[:, None] - entries[None]) ** 2).sum(axis=2)
        tree = codes.Tree(entries)
        at, best = tree.nearest(q)
        assert (at == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


def test_tree_leaves_halves_out():
    rng = np.random.default_rng(6)
    centres = rng.integers(-10000, 10000, (8, 4))
    entries = np.concatenate([c + rng.integers(-5, 6, (8, 4)) for c in centres])
    q = centres[rng.integers(0, 8, 1000)] + rng.integers(-5, 6, (1000, 4))
    tree = codes.Tree(entries)
    tree.nearest(q)
    assert tree.measured < 0.5 * q.shape[0] * entries.shape[0]


def test_roots_are_rounded_down_and_up():
    s = np.array([0, 1, 2, 3, 4, (1 << 30) ** 2 - 1, (1 << 30) ** 2, (1 << 30) ** 2 + 1, 3037000499**2 - 1])
    low, high = codes.roots(s)
    assert [math.isqrt(v) for v in s.tolist()] == low.tolist() and [math.isqrt(v - 1) + 1 if v else 0 for v in s.tolist()] == high.tolist()


def test_codes_by_definition(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(0, 0.3, 32).round(2).tolist(), int(i) % 3 if i % 4 else None) for i in rng.permutation(150)]
    rows += [(7, rows[3][1], 1), (None, rows[5][1], None), (None, [0.5] * 32, 2), rows[0], rows[0]]  # ties, null ids, repeated rows
    rows += [(900, None, 1), (901, [None] + [0.1] * 31, 1), (902, [float("nan")] + [0.1] * 31, 1), (903, [float("-inf")] + [0.1] * 31, 1)]
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    want, digest = plain_codes(rows)
    by_label = {}
    for _, lab, _, e in want:
        by_label[lab] = by_label.get(lab, 0) + e
    got = registry.QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=key) == sorted(((i, c, e, by_label[lab]) for i, lab, c, e in want), key=key)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_codes_of_odd_tables(spark, tmp_path):
    empty = frame(spark, [])
    assert codes.codebooks(empty) is None
    empty.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert registry.QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect() == []
    # Unequal lengths and none at all, great components, other columns with names of the result.
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "x", 5), (2, [], None, "y", 6), (3, [1e30], 1, "z", 7)], f"{SCHEMA}, code string, error int")
    books = codes.codebooks(odd)
    assert books.shape == (16, 3, 1) and books[0].ravel().tolist() == [256, 0, codes.LIMIT]
    out = {r.vec_id: r for r in codes.encoded(odd, books).collect()}
    assert [out[i].error for i in (1, 2, 3)] == [0, 0, 0]
    assert [out[i].code for i in (1, 2, 3)] == ["000000" + "00" * 13, "010101" + "00" * 13, "020101" + "00" * 13]


def test_codes_stand_for_near_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 16).tolist(), 0) for i in range(300)]
    v = frame(spark, rows)
    books = codes.codebooks(v)
    back = {r.vec_id: np.array(r.vector) for r in codes.decoded(codes.encoded(v, books), books).collect()}
    assert np.mean([((back[i] - np.array(x)) ** 2).mean() for i, x, _ in rows]) < 0.02


def plain_whitening(rows, k=16):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v, _ in rows])
    once = np.unique(x, axis=0)
    n, s = len(once), once.sum(axis=0)
    c = once - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, n, s, e[::-1], v[:, ::-1]


def test_whitening_by_definition(spark, tmp_path):
    rng = np.random.default_rng(3)
    scales = np.geomspace(1, 20, 24)
    rows = [(i, (rng.normal(0, 1, 24) * scales).tolist(), 0) for i in range(400)]
    rows += [(401 + i, rows[0][1], 0) for i in range(50)]
    bad = [(900, None, 1), (901, [None] + [0.1] * 23, 1), (902, [float("inf")] * 24, 1)]
    frame(spark, rows + bad).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.QUERIES["op13_whiten_embeddings"](spark, str(tmp_path)).toPandas().sort_values(["vec_id", "component"])
    x, n, s, e, v = plain_whitening(rows)
    assert len(got) == 450 * 16 and set(got.n) == {n} and n == 400
    assert got.component.tolist() == list(range(1, 17)) * 450
    assert got.deviation.tolist() == np.repeat([sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s)) for r in x], 16).tolist()
    assert np.allclose(got.explained.to_numpy()[:16], (e / e.sum())[:16], rtol=1e-9)
    w = got.whitened.to_numpy().reshape(-1, 16)
    want = ((x - s / n) @ v[:, :16]) / np.sqrt(e[:16])
    sign = np.sign((w * want).sum(axis=0))
    assert np.allclose(w, want * sign, atol=1e-8)
    assert got.identity_error.nunique() == 1 and 0 < got.identity_error.iloc[0] < 1e-9
    once = w[np.unique(x, axis=0, return_index=True)[1]]
    assert np.allclose(np.cov(once.T, bias=True), np.eye(16), atol=1e-9)


def test_whitening_keeps_small_deviations():
    """Columns whose deviations are ten orders apart: R's columns give the small ones, a covariance wouldn't."""
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(300, 9)))
    turn, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    lengths = np.geomspace(1e6, 1e-2, 9)
    a = (q * lengths) @ turn.T
    r = None
    for block in np.array_split(a, 7):
        r = whitening.triangle(r, block)
    found, v = whitening.jacobi(r)
    assert np.allclose(found, lengths, rtol=1e-6)
    assert np.allclose(v.T @ v, np.eye(9), atol=1e-13)
    zero, v = whitening.jacobi(np.zeros((1, 3)))
    assert zero.tolist() == [0, 0, 0] and np.allclose(v, np.eye(3))


def test_whitening_of_odd_tables(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert registry.QUERIES["op13_whiten_embeddings"](spark, str(tmp_path)).collect() == []
    assert whitening.whitened(frame(spark, [(1, [], 1)]), whitening.fit(frame(spark, [(1, [], 1)]))).collect() == []
    # One distinct vector: no variance; nulls say so.
    one = frame(spark, [(1, [0.5, 1.0], 1), (2, [0.5, 1.0], 1), (None, [0.5, 1.0], None)])
    rows = whitening.whitened(one, whitening.fit(one)).collect()
    assert len(rows) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained == 0 and r.identity_error == 0 for r in rows)
    # A dependent dimension, unequal lengths, names of the result taken.
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i] + [1.0] * (i % 2), "x") for i in range(40)], "vec_id long, embedding array<float>, whitened string")
    model = whitening.fit(flat)
    out = whitening.whitened(flat, model).toPandas()
    assert len(out) == 120 and (out[out.component == 3].explained == 0).all() and out[out.component == 3].whitened.isna().all()
    assert out[out.component < 3].whitened.notna().all() and model.identity_error < 1e-9


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, 1], [0, 1], [1 << 30, 1]])
    sums = tuple(int(v) for v in x.sum(axis=0))
    want = [sum((3 * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x]
    assert whitening.deviations(x, 3, sums) == [v if v < 1 << 63 else None for v in want]


def test_centre_is_exact():
    model = whitening.Whitening(3, (3_000_001, -4), np.zeros((2, 0)), np.zeros(0), 0.0)
    got = model.centre(np.array([[1_000_000, -1]]))
    assert np.allclose(got, [[float(-Fraction(1, 3)), float(Fraction(1, 3))]], rtol=1e-15)


def test_pack_keeps_equal_rows_equal():
    x = np.array([[1, 2], [1 << 40, 2], [1, 2]])
    p = whitening.pack(x)
    assert p[0] == p[2] != p[1]
    import pyarrow as pa

    assert (whitening.unpack(pa.array(p), 2) == x).all()
    assert floors(pa.array([[0.5], []], pa.list_(pa.float32())), 2, 64, 100).tolist() == [[32, 0], [0, 0]]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_whiten_embeddings"])
def test_reruns_agree(spark, name):
    sf = "/root/testdata/sf0.001"
    one, two = (sorted(map(tuple, registry.QUERIES[name](spark, sf).select("vec_id", *(["code"] if "code" in name else ["component", "n", "deviation"])).collect())) for _ in range(2))
    assert one == two and one
