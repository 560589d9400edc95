"""Refined eigenvectors against exact spectra, whitening against numpy; edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nnspark.llm import whitening
from nnspark.llm.common import TAG

SF001 = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"


def spectrum(values, seed):
    """A symmetric matrix of the given eigenvalues, and its eigenvectors, from extended precision."""
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    q = q.astype(np.longdouble)
    for _ in range(4):  # orthogonal to extended precision
        q = q + q @ (np.eye(len(values)) - q.T @ q) / 2
    m = (q * np.asarray(values, np.longdouble)) @ q.T
    return ((m + m.T) / 2).astype(np.float64), q.astype(np.float64)


@pytest.mark.parametrize("values", [
    np.arange(1, 41)[::-1] / 7,
    1000.0 ** -np.arange(12),
    [5, 1 + 3e-9, 1 + 2e-9, 1 + 1e-9, 1, 0.5],          # closer than single precision can tell apart
    [2 + 1e-7, 2, 2 - 1e-12, 1, 1, 1],                  # and equal ones
    [3.0] * 8,
    [4.0, 1.0, 0.0, 0.0],
])
def test_eigenpairs_reach_double_precision(values):
    values = np.sort(np.asarray(values, float))[::-1]
    matrix, _ = spectrum(values, len(values))
    found, x = whitening.eigenpairs(matrix)
    assert np.abs(found - values).max() <= 4e-15 * values[0] * math.sqrt(len(values))
    assert np.abs(x.T @ x - np.eye(len(values))).max() <= 4e-15
    assert np.abs(matrix @ x - x * found).max() <= 1e-14 * values[0]


def test_refinement_beats_single_precision_and_equals_the_true_vectors():
    values = np.linspace(2, 1, 30)
    matrix, true = spectrum(values, 5)
    _, x = whitening.eigenpairs(matrix)
    assert np.abs(np.abs(np.sum(x * true, axis=0)) - 1).max() <= 1e-14
    single = np.linalg.eigh(matrix.astype(np.float32))[1][:, ::-1].astype(float)
    wrong = np.abs(single - true * np.sign(np.sum(single * true, axis=0))).max()
    right = np.abs(x - true * np.sign(np.sum(x * true, axis=0))).max()
    assert right <= 1e-13 < wrong


def brute(vectors):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    d = n * x - total
    centred = d.astype(np.float64) / n
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1], q[:, ::-1]
    k = min(32, len(values), int((values > values[0] * len(values) * 2.3e-16).sum()))
    return [sum(int(e) ** 2 for e in row) for row in d], centred @ q[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(found, ids, vectors):
    deviation, white, explained = brute(vectors)
    k = white.shape[1]
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert len(by) == len(found) == len(ids) * k
    got = np.array([[by[i, j + 1]["whitened"] for j in range(k)] for i in ids])
    sign = np.sign(np.sum(got * white, axis=0))
    assert np.abs(got * sign - white).max() < 1e-9
    assert [by[i, 1]["deviation"] for i in ids] == deviation
    assert all(abs(by[i, j + 1]["explained"] - explained[j]) < 1e-12 for i in ids[:3] for j in range(k))
    assert {r["n"] for r in found} == {len(ids)}
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-12


def test_whole_table_matches_numpy(spark):
    table = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    check(whitening.whiten(table).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_rows_that_have_no_place_are_dropped(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(40, 5)).astype(np.float32)
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(good)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf")] + [0.0] * 4),
           (105, [1.0, 2.0]), (106, [1e30] * 5)]
    table = spark.createDataFrame(rows[:20] + bad + rows[20:], VECTORS).repartition(4)
    check(whitening.whiten(table).collect(), list(range(40)), good)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, [float(i), float(i * i % 7)]) for i in range(9)] + [(1, [3.0, 1.0]), (1, [3.0, 1.0])]
    table = spark.createDataFrame(rows, VECTORS).withColumn("whitened", F.lit("w")).withColumn("v", F.lit(1)).withColumn("n", F.lit(2))
    found = whitening.whiten(table).collect()
    assert len(found) == 22 and {r["n"] for r in found} == {11}
    assert len({r["whitened"] for r in found if r["vec_id"] == 1 and r["component"] == 1}) == 1
    tagged = whitening.transform(table, whitening.fit(table)).collect()
    assert {(r["whitened"], r["v"], r["n"], len(r[TAG]["whitened"])) for r in tagged} == {("w", 1, 2, 2)}


def test_no_vectors_no_variance_and_large_deviations(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(empty).collect() == [] and whitening.whiten(spark.createDataFrame([(1, None)], VECTORS)).collect() == []
    assert whitening.whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, VECTORS)).collect() == []
    flat = [(i, [float(i), 2.0]) for i in range(4)]  # one dimension without variance: one component
    assert {r["component"] for r in whitening.whiten(spark.createDataFrame(flat, VECTORS)).collect()} == {1}
    wide = [(i, [float(i) * 2.0 ** 30, float(i % 2)]) for i in range(4)]
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(wide, VECTORS)).collect()}
    exact = {i: sum((4 * x[i] - sum(x)) ** 2 for x in ([64 * j * 2 ** 30 + 10 ** 6 for j in range(4)], [64 * (j % 2) + 10 ** 6 for j in range(4)]))
             for i in range(4)}
    assert found == {i: e if e < 2 ** 63 else None for i, e in exact.items()}
