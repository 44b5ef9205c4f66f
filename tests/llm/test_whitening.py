"""Whitened embeddings against exact sums and known eigenvectors."""

from fractions import Fraction

import numpy as np
import pytest

from tenderlake.llm import whitening as W
from tenderlake.llm.queries_whitening import op13_whitening

from ..oracle import DATA


def integers(rows):
    return [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in rows]


def checked(found, vectors, k):
    """Every property of the contract: exact deviations, unit eigenvectors, unit covariance."""
    x = integers([v for _, v in vectors])
    n, d = len(x), len(x[0])
    sums = [sum(v[j] for v in x) for j in range(d)]
    centred = np.array([[float(Fraction(n * v[j] - sums[j], n)) for j in range(d)] for v in x])
    cov = centred.T @ centred / n
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1], directions[:, ::-1]
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert len(found) == len(by) == n * k
    got = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i, _ in vectors])
    for m, (i, _) in enumerate(vectors):
        assert by[i, 1]["n"] == n and int(by[i, 1]["deviation"]) == sum((n * x[m][j] - sums[j]) ** 2 for j in range(d))
    expect = centred @ directions[:, :k] / np.sqrt(values[:k])
    signs = np.sign((got * expect).sum(axis=0))
    assert np.abs(got - expect * signs).max() < 1e-8
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9 and found[0]["identity_error"] < 1e-9
    explained = [by[vectors[0][0], c + 1]["explained"] for c in range(k)]
    assert np.allclose(explained, values[:k] / np.trace(cov), rtol=1e-9) and explained == sorted(explained, reverse=True)


def test_query(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    good = [(r["vec_id"], r["embedding"]) for r in rows if r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    checked(op13_whitening(spark, DATA).collect(), good, 32)


def test_odd_rows(spark):
    r = np.random.default_rng(1)
    plain = [(i, [float(v) for v in np.float32(r.normal(3, 1 + np.arange(6)))]) for i in range(50)]
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6), (104, [float("inf")] + [0.0] * 5), (105, [1.0, 2.0]), (106, [3e38] * 6)]
    df = spark.createDataFrame([(*row, 1, 2, 3, 4) for row in plain + odd], "vec_id long, embedding array<float>, n int, id int, component int, v int").repartition(7)
    found = W.whitened(df, components=32).withColumnRenamed("id", "vec_id").collect()
    checked(found, plain, 6)
    assert W.whitened(df.limit(0)).count() == 0
    equal = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert W.whitened(equal).count() == 0
    line = spark.createDataFrame([(None, [0.0, 1.0, 5.0]), (1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0])], "vec_id long, embedding array<double>")
    got = W.whitened(line).collect()
    assert len(got) == 3 and {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12 and sum(r["id"] is None for r in got) == 1


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**52 + 2**20 * i), float((-1) ** i * 2**53), float(i * i)]) for i in range(40)]
    found = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    x = integers([v for _, v in rows])
    sums = [sum(v[j] for v in x) for j in range(3)]
    assert {r["id"]: int(r["deviation"]) for r in found if r["deviation"] is not None} == {
        i: total for i, v in enumerate(x) if (total := sum((40 * a - s) ** 2 for a, s in zip(v, sums))) < 10**38
    }
    assert np.array_equal(W.exact_products(np.array(x)), np.array(x, object).T @ np.array(x, object))


@pytest.mark.parametrize(
    "values",
    [np.arange(1, 31.0), 1 + 1e-9 * np.arange(20), np.r_[5 + 1e-12 * np.arange(5), 3 + 1e-6 * np.arange(5), np.zeros(5)], np.r_[1e8, 1, 1e-8, 1e-8 * (1 + 1e-7)], np.ones(6), np.zeros(4)],
)
def test_eigenpairs_with_clusters(values):
    r = np.random.default_rng(2)
    d = len(values)
    q = np.linalg.qr(r.normal(size=(d, d)))[0].astype(W.Real)
    for _ in range(3):
        q = q @ (1.5 * np.eye(d, dtype=W.Real) - (q.T @ q) / 2)
    a = q @ np.diag(values.astype(W.Real)) @ q.T
    a = (a + a.T) / 2
    found, x = W.eigenpairs(a)
    size = max(float(np.abs(values).max()), 1.0)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-17 and np.abs(found - np.sort(values)[::-1]).max() < 1e-17 * size * d
    assert np.abs(a @ x - x * found).max() < 1e-17 * size * d
    # vectors: each within the error that its gap allows in extended precision, far below that of single or double precision
    order = np.argsort(-values, kind="stable")
    q, values = q[:, order], values[order]
    for i in range(d):
        gap = min([abs(values[i] - v) for j, v in enumerate(values) if j != i])
        if gap > 0:
            assert 1 - abs(float(q[:, i] @ x[:, i])) < max(1e-18 * size / gap, 1e-15) * 10
