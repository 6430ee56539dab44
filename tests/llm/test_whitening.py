from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import contour, whitening as W


def symmetric(values, seed=0):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    return q * np.array(values, float) @ q.T


@pytest.mark.parametrize("values", [
    range(1, 65), [5.0, 4.0, 3.0, 2.0, 1.0], [9, 9, 9, 1, 1, 1, 0, 0],
    [1e6, 1e3, 1, 1e-3, 1e-6], [2.0] * 30, [7.0], [3, 0, 0, 0],
    [1 + i * 1e-9 for i in range(20)], np.linspace(0.9, 1.1, 200)])
def test_contour_pairs_equal_the_dense_solver(values):
    v = symmetric(values)
    v = (v + v.T) / 2
    for wanted in (1, 4, 40):
        got, vectors = contour.largest(v, wanted)
        want = np.sort([x for x in values if x > 1e-12])[::-1][:wanted]
        scale = max(values)
        assert np.allclose(got, want, rtol=0, atol=1e-12 * scale)
        assert np.abs(vectors @ v - got[:, None] * vectors
                      ).max() < 1e-11 * scale
        assert np.abs(vectors @ vectors.T - np.eye(len(got))).max() < 1e-9


def test_inertia_counts_eigenvalues_above():
    v = symmetric([5, 3, 3, 1, 0.5, -2])
    above = contour.inertia(v)
    assert [above(s) for s in (6, 4, 2, 0.7, 0, -3)] == [0, 1, 3, 4, 5, 6]


def test_no_matrix_and_no_variance():
    for v in (np.zeros((0, 0)), np.zeros((3, 3))):
        assert len(contour.largest(v, 4)[0]) == 0


def rows_of(spark, vectors):
    return spark.createDataFrame(
        list(enumerate(vectors)), "vec_id bigint, embedding array<float>")


def test_equals_the_dense_computation(spark, scratch):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) / 9
    data = data.astype(np.float32)
    vectors = [list(map(float, v)) for v in data] + [
        list(map(float, data[0]))] * 5 + [
        None, [1.0] * 11 + [None], [float("nan")] * 12, [1.0]]
    df = rows_of(spark, vectors).repartition(3).withColumn(
        "x", F.lit("clash"))
    got = W.whiten(scratch, df).collect()
    x = np.floor(256 * data.astype(float)).astype(int)
    each = np.unique(x, axis=0)
    n, s = len(each), each.sum(axis=0)
    centred = each - s / n
    v = centred.T @ centred / n
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(got) == 305 * 4
    for r in got:
        own = x[r["vec_id"] if r["vec_id"] < 300 else 0]
        k = r["component"] - 1
        want = (own - s / n) @ basis[:, k] / values[k] ** 0.5
        assert r["n"] == n
        assert int(r["deviation"]) == sum(
            (n * int(a) - int(b)) ** 2 for a, b in zip(own, s))
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
        assert r["explained"] == pytest.approx(values[k] / np.trace(v))
        assert r["identity_error"] < 1e-9
    one = [r for r in got if r["vec_id"] in (0, 302) and r["component"] == 1]
    assert one[0]["whitened"] == one[1]["whitened"]


def test_small_empty_and_huge_tables(spark, scratch):
    for vectors in ([], [None], [[1.0, 2.0]] * 3, [[]]):
        assert W.whiten(scratch, rows_of(spark, vectors)).count() == 0
    got = W.whiten(scratch, rows_of(spark, [[0.0, 5.0], [1.0, 5.0]]))
    for r in got.collect():
        assert r["component"] == 1 and r["vec_id"] in (0, 1)
        assert abs(r["whitened"]) == pytest.approx(1)
        assert r["explained"] == pytest.approx(1)
    assert got.count() == 2
    # entries whose sums are beyond the range of doubles stay exact
    big = [[2.0 ** 40, 1.0], [3.0, 2.0 ** 30], [2.0 ** 20, 7.0]]
    got = {r["vec_id"]: int(r["deviation"]) for r in W.whiten(
        scratch, rows_of(spark, big)).collect()}
    x = [[int(256 * c) for c in v] for v in big]
    s = [sum(c) for c in zip(*x)]
    assert got == {i: sum((3 * a - b) ** 2 for a, b in zip(v, s))
                   for i, v in enumerate(x)}
    assert Fraction(got[0]).denominator == 1
