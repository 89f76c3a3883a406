import math
from collections import defaultdict

import numpy as np
import pytest

from ebbtide.llm import whitening
from ebbtide.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def whole(rows):
    found = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            found.append((i, [math.floor(64 * float(np.float32(x))) + 1_000_000 for x in v]))
    width = max((len(x) for _, x in found), default=0)
    return [(i, x + [1_000_000] * (width - len(x))) for i, x in found]


def check(found, rows, components=32):
    """Everything in a result that its definition fixes, with numpy's own decomposition."""
    rows = whole(rows)
    n = len(rows)
    x = np.array([r for _, r in rows])
    sums = x.sum(axis=0)
    y = (n * x - sums) / n
    v = y.T @ y / n
    values = np.linalg.eigvalsh(v)[::-1]
    k = int((values[:components] > 1e-11 * values[0]).sum())
    assert len(found) == n * k
    by_row = defaultdict(dict)
    for r in found:
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-9)
        key = (r["vec_id"], r["deviation"])
        by_row[key].setdefault(r["component"], []).append(r["whitened"])
    wanted = [(i, int(((n * np.array(r) - sums).astype(object) ** 2).sum())) for i, r in rows]
    assert set(by_row) == set(wanted)
    # Rows that differ in id or deviation are told apart; of the others only the set is known.
    alone = [i for i, key in enumerate(wanted) if wanted.count(key) == 1]
    w = np.array([[by_row[wanted[i]][c + 1][0] for c in range(k)] for i in alone])
    # All of them come from one projection P / sqrt(e), and P has unit eigenvectors of V.
    p = np.linalg.lstsq(y[alone], w, rcond=None)[0] * np.sqrt(values[:k])
    if np.linalg.matrix_rank(y[alone]) == y.shape[1]:
        assert np.abs(p.T @ p - np.eye(k)).max() < 1e-8
        assert np.abs(v @ p - p * values[:k]).max() < 1e-9 * values[0]
    assert np.abs(y[alone] @ p / np.sqrt(values[:k]) - w).max() < 1e-8


def test_query_equals_the_decomposition(spark, folder):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/embeddings.parquet")
            .select("vec_id", "embedding").collect()]
    check(QUERIES["op12_whitening"](spark, folder).collect(), rows)


def test_odd_vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=5).astype(np.float32).tolist()) for i in range(50)]
    rows += [(7, rows[8][1]), (7, rows[8][1]), (None, [0.5, 0.25, 0.0, 1.0, 2.0]), (100, None), (101, []),
             (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("-inf")] * 5),
             (105, [3.0, -1.0])]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS x", "2 AS n", "3 AS component")
    found = whitening.whitened(frame.repartition(3)).collect()
    check(found, rows)
    assert sum(r["vec_id"] == 7 for r in found) == 3 * 5


def test_no_variance_no_rows(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [0.5, 2.0])], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [0.5])] * 9, SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [])] * 3, SCHEMA)).count() == 0


def test_dependent_and_constant_dimensions(spark):
    draw = np.random.default_rng(5)
    base = np.floor(draw.normal(size=(40, 2)) * 100)
    rows = [(i, [float(a), float(b), float(a + b), 7.0]) for i, (a, b) in enumerate(base)]
    found = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in found} == {1, 2}
    assert all(r["identity_error"] < 1e-9 for r in found)


def test_large_values_stay_exact(spark):
    rows = [(i, [float(i), 1e16 * (i % 3), 1e300 if i == 5 else 0.0]) for i in range(10)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whitening.whitened(frame).collect()
    assert {r["vec_id"] for r in found} == set(range(10)) and {r["deviation"] for r in found} == {None}
    small = whitening.whitened(frame.where("vec_id < 2")).collect()
    assert {r["deviation"] for r in small} == {None}
    near = [(i, [1e9 * i]) for i in range(2)]
    found = whitening.whitened(spark.createDataFrame(near, "vec_id long, embedding array<double>"))
    assert {r["deviation"] for r in found.collect()} == {64**2 * 10**18 if 64**2 * 10**18 < 2**63 else None}


def test_too_wide(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_DIMENSIONS", 3)
    with pytest.raises(ValueError):
        whitening.whitened(spark.createDataFrame([(1, [1.0] * 4)], SCHEMA))


def matrices():
    draw = np.random.default_rng(2)
    for n in (1, 2, 3, 12, 60):
        b = draw.normal(size=(n, n))
        yield b @ b.T
    yield np.eye(6)
    yield np.diag([5.0, 5.0, 5.0, 1.0, 0.0])
    q, _ = np.linalg.qr(draw.normal(size=(40, 40)))
    yield q @ np.diag([9.0] * 10 + [9 - 1e-13] * 10 + [1.0] * 20) @ q.T
    yield q @ np.diag(np.geomspace(1, 1e-14, 40)) @ q.T
    yield np.kron(np.eye(3), np.array([[2.0, 1.0], [1.0, 2.0]]))


@pytest.mark.parametrize("matrix", list(matrices()))
def test_leading_pairs(matrix):
    matrix = (matrix + matrix.T) / 2
    k = min(32, len(matrix))
    values, vectors = whitening.leading(matrix, k)
    exact = np.linalg.eigvalsh(matrix)[::-1][:k]
    scale = abs(exact[0])
    assert np.abs(values - exact).max() < 1e-14 * scale * len(matrix)
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 * scale * len(matrix)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-11


def test_tridiagonal_form_has_the_same_values():
    b = np.random.default_rng(3).normal(size=(15, 15))
    matrix = b + b.T
    d, e, _ = whitening.tridiagonal(matrix)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    exact = np.linalg.eigvalsh(matrix)
    assert np.allclose(np.linalg.eigvalsh(t), exact)
    assert whitening.sturm_counts(d, e, exact[::3] + 1e-9).tolist() == [1, 4, 7, 10, 13]
