"""Whitening against numpy: factor, rotation, and whole tables with missing, ragged and repeated vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import whitening as W


def brute(vectors, most=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, u = np.linalg.eigh(centred.T @ centred / n)
    values, u = values[::-1], u[:, ::-1].T
    deviation = [int(v) for v in ((n * x.astype(object) - sums.astype(object)) ** 2).sum(1)]
    k = min(most, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    return n, values[:k], values.sum(), u[:k], centred @ u[:k].T / np.sqrt(values[:k]), deviation


def table(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("component", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("id", F.lit(1)).repartition(3)


@pytest.mark.parametrize("size", [3, 40])
def test_rows_equal_numpy(spark, size):
    rng = np.random.default_rng(size)
    base = (rng.normal(0, 1, (300, size)) * np.linspace(0.2, 3, size)).astype(np.float32)
    good = [(i, [float(v) for v in r]) for i, r in enumerate(base)] + [(7, [float(v) for v in base[7]]), (None, [float(v) for v in base[0]])]
    bad = [(900, None), (901, []), (902, [None] * size), (903, [float("nan")] + [1.0] * (size - 1)), (904, [float("inf")] * size), (905, [1.0] * (size + 1))]
    df = table(spark, good + bad)
    white = W.fit(df, "embedding")
    out = W.transform(df, "vec_id", "embedding", white).collect()
    n, values, trace, u, whitened, deviation = brute([v for _, v in good])
    k = min(32, size)
    assert len(out) == len(good) * k and {r.n for r in out} == {n} and len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-10
    sign = np.sign((u * white.components).sum(1))
    assert np.abs(white.components - sign[:, None] * u).max() < 1e-9
    by = {}
    for r in out:
        by.setdefault((r.vec_id, r.component), []).append((r.whitened, r.deviation, r.explained))
    want = {}
    for (key, _), z, d in zip(good, whitened, deviation):
        for c in range(k):
            want.setdefault((key, c + 1), []).append((z[c] * sign[c], d, values[c] / trace))
    assert by.keys() == want.keys()
    for key, rows in want.items():
        for (a, b, c), (x, y, z) in zip(sorted(by[key]), sorted(rows)):
            assert a == pytest.approx(x, abs=1e-9) and b == y and c == pytest.approx(z)


def test_rank_deficient_equal_and_empty_tables(spark):
    line = table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(20)])
    out = W.transform(line, "vec_id", "embedding", W.fit(line, "embedding")).collect()
    assert {r.component for r in out} == {1} and out[0].explained == pytest.approx(1)
    equal = table(spark, [(i, [1.0, 2.0]) for i in range(5)])
    assert W.transform(equal, "vec_id", "embedding", W.fit(equal, "embedding")).count() == 0
    for rows in (equal.where("false"), table(spark, [(1, None), (2, [])])):
        none = W.transform(rows, "vec_id", "embedding", W.fit(rows, "embedding"))
        assert none.count() == 0 and none.columns[:2] == ["vec_id", "component"]


def test_entries_beyond_64_bits_do_not_fail(spark):
    df = table(spark, [(i, [1e30 * (-1) ** i, float(i % 3), 1e9 * (i % 5)]) for i in range(12)])
    out = W.transform(df, "vec_id", "embedding", W.fit(df, "embedding")).collect()
    assert len(out) >= 12 and all(np.isfinite(r.whitened) for r in out)


def test_factor_and_rotation():
    rng = np.random.default_rng(1)
    for rank, size in ((5, 9), (12, 12), (1, 4)):
        b = rng.normal(0, 1, (size, rank)) * np.logspace(0, -3, rank)
        factor = W.pivoted_cholesky(b @ b.T)
        assert factor.shape == (size, rank) and np.abs(factor @ factor.T - b @ b.T).max() < 1e-12
        values, parts = W.one_sided_jacobi(factor)
        assert values == pytest.approx(np.linalg.eigvalsh(b @ b.T)[::-1][:rank]) and np.abs(parts @ parts.T - np.eye(rank)).max() < 1e-12
    assert W.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
