"""Whitening against sums of exact fractions and numpy; hard and empty tables."""

import random
from fractions import Fraction

import numpy as np

from codesift.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, row string, v int, value double, n long, whitened string"


def table(spark, vectors):
    return spark.createDataFrame([(k, v, "r", 1, 2.0, 3, "w") for k, v in enumerate(vectors)], SCHEMA)


def whole(vectors, width):
    return [[int(np.floor(64 * c)) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for v in vectors]


def exact(x):
    """Sums and covariances as fractions, from products of centred values."""
    n, width = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(width)]
    y = [[n * r[i] - s[i] for i in range(width)] for r in x]
    v = [[Fraction(sum(r[i] * r[j] for r in y), n ** 3) for j in range(width)] for i in range(width)]
    return s, v, [sum(a * a for a in r) for r in y]


def vectors(seed, n, width, size=1.0):
    pick = np.random.default_rng(seed)
    return (pick.normal(size=(n, width)) @ pick.normal(size=(width, width)) * size + pick.normal(size=width)).tolist()


def held(spark, data, k=32):
    width = max(map(len, data))
    s, v, deviations = exact(whole(data, width))
    values, basis = np.linalg.eigh(np.array([[float(a) for a in r] for r in v]))
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    x = np.array(whole(data, width), float) - np.array([a / len(data) for a in s])
    found = sorted(whitening.whitened(table(spark, data), components=k).collect(), key=lambda r: r["row"]["vec_id"])
    z = np.array([r["whitened"] for r in found])
    want = x @ basis / np.sqrt(values)
    sign = np.sign((z * want).sum(axis=0))
    assert np.allclose(z, want * sign, rtol=1e-6, atol=1e-6)
    assert [r["deviation"] for r in found] == [d if d < 1 << 63 else None for d in deviations]
    assert {r["n"] for r in found} == {len(data)} and found[0]["identity_error"] < 1e-6
    assert np.allclose(found[0]["explained"], values / float(sum(v[i][i] for i in range(width))), rtol=1e-9)
    return found


def test_against_fractions(spark):
    held(spark, vectors(1, 200, 7))
    held(spark, vectors(2, 150, 5, 1e4), 3)
    held(spark, vectors(3, 60, 4, 1e9))  # squares beyond 64 bits: the sums stay exact


def test_polarisation_is_the_nearest_double(spark):
    data = vectors(4, 90, 6, 1e9)
    good = table(spark, data)
    v = whitening.covariance(good, "embedding", whitening.sums(good, "embedding"))
    _, want, _ = exact(whole(data, 6))
    assert v.tolist() == [[float(a) for a in r] for r in want]


def test_rows_that_are_left_out_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    data = [v for v in vectors(5, 40, 3)] + [[1.0, 2.0], [], [5.0]]
    bad = [None, [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, inf, 1.0], [1.0, -inf, 1.0]]
    random.Random(1).shuffle(data)
    found = whitening.whitened(table(spark, bad + data + data)).collect()
    assert len(found) == 2 * len(data) and {r["n"] for r in found} == {2 * len(data)}
    assert {r["row"]["vec_id"] for r in found} == set(range(len(bad), len(bad) + 2 * len(data)))
    held(spark, data)


def test_no_variance(spark):
    for data in ([[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]], [None], []):
        found = whitening.whitened(table(spark, data)).collect()
        assert all(r["whitened"] == [] and r["explained"] == [] and r["identity_error"] == 0.0 and r["deviation"] == 0 for r in found)
        assert len(found) == sum(v is not None for v in data)
    found = whitening.whitened(table(spark, [[float(k), 3.0] for k in range(9)])).collect()  # one dimension without any
    assert all(len(r["whitened"]) == 1 for r in found) and found[0]["identity_error"] < 1e-9


def test_all_columns_stay(spark):
    found = whitening.whitened(table(spark, vectors(6, 10, 3)))
    assert found.select("row.*").columns == table(spark, []).columns
