"""Embedding whitening beside whole-number and floating-point arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from keyloom.llm import whitening
from keyloom.staging import Stage

SCHEMA = "vec_id bigint, embedding array<float>, label int, component string, x int, n string"
RNG = np.random.default_rng(5)
BASE = (RNG.normal(size=(400, 20)) * np.geomspace(1, 0.05, 20) + RNG.normal(size=20)).astype(np.float32)
VECTORS = [v.tolist() for v in BASE] + [BASE[0].tolist()] * 300  # a third are copies
AWKWARD = [
    None, [], [1.0] * 19, [None] + [1.0] * 19, [math.nan] * 20, [math.inf] + [0.0] * 19, [-math.inf] * 20,
]


def frame(spark, vectors, ids=None):
    rows = [(i, v, 1, "c", 2, "n") for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def truth(vectors):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    far = n * fit - sums
    covariance = (far.T @ far) / n**3
    values, axes = np.linalg.eigh(covariance)
    return x, n, sums, values[::-1], axes[:, ::-1], np.trace(covariance)


def test_against_numpy(spark):
    vectors = VECTORS + AWKWARD
    rows = whitening.whitened(frame(spark, vectors)).collect()
    x, n, sums, values, axes, trace = truth(VECTORS)
    assert len(rows) == len(VECTORS) * 16
    by_id = {(r.vec_id, r.component): r for r in rows}
    assert set(by_id) == {(i, c) for i in range(len(VECTORS)) for c in range(1, 17)}
    sign = {}
    for i in range(len(VECTORS)):
        far = [n * int(v) - int(s) for v, s in zip(x[i], sums)]
        for c in range(1, 17):
            r = by_id[i, c]
            assert r.n == n and r.deviation == sum(f * f for f in far)
            assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-9)
            assert 0 <= r.identity_error < 1e-9
            exact = np.array(far) / n @ axes[:, c - 1] / math.sqrt(values[c - 1])
            if abs(exact) > 1e-3:
                sign.setdefault(c, math.copysign(1, exact * r.whitened))
            assert sign.get(c, 1) * r.whitened == pytest.approx(exact, rel=1e-6, abs=1e-6)


def test_planes_count_exactly():
    wide = [2**40, -(2**40), 7]
    for low, high, n in ((-40, 40, 1000), (0, 1, 1), (-(10**9), 10**9, 130), (5, 6, 64)):
        z = RNG.integers(low, high, (n, 7))
        z[:, 2] = wide[n % 3]
        sums, products = whitening.scatter(z)
        z = z.astype(object)
        assert (sums == z.sum(axis=0)).all() and (products == z.T @ z).all()


def test_packed_rows_come_back():
    z = np.array([[1, -128, 3], [1, -129, 3], [2**40, 0, -1], [2**31, 0, 0], [-(2**31), 0, 0], [127, 0, 0]])
    rows = whitening.packed(z)
    assert [len(r) for r in rows] == [3, 6, 24, 24, 12, 3]
    assert (whitening.unpacked(rows, 3) == z).all()


def test_covariance_of_far_vectors_is_exact(spark):
    """A common offset of 2^20 costs nothing, because it is taken away in whole numbers."""
    v = RNG.integers(-3, 4, (200, 5)) / 64
    near = whitening.whitened(frame(spark, v.tolist())).collect()
    far = whitening.whitened(frame(spark, (v + 2.0**17).tolist())).collect()
    key = lambda r: (r.vec_id, r.component)
    for a, b in zip(sorted(near, key=key), sorted(far, key=key)):
        assert (a.deviation, a.explained) == (b.deviation, b.explained)
        assert abs(a.whitened) == pytest.approx(abs(b.whitened), rel=1e-12)


def test_fit_is_the_exact_scatter(spark):
    found, width = whitening.vectors(frame(spark, VECTORS))
    fitted = whitening.fit_list(found, width, Stage(spark))
    model = whitening.fit(fitted, width)
    x, n, sums, *_ = truth(VECTORS)
    assert fitted.count() == model.n == n
    assert [int(s) + n * whitening.ORIGIN for s in model.sums] == sums.tolist()
    trace = sum(
        Fraction(n * int((fit := np.unique(x, axis=0))[:, i].astype(object) @ fit[:, i]) - int(sums[i]) ** 2, n * n)
        for i in range(width)
    )
    assert model.trace == pytest.approx(float(trace), rel=1e-14)


def test_awkward_tables(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, AWKWARD[:2] + AWKWARD[3:])).count() == 0
    one = whitening.whitened(frame(spark, [[0.5, 2.0]] * 3, [None, 7, 7])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (c, 1, 0, None, None, None) for _ in range(3) for c in (1, 2)
    ]
    # A dimension without variance: its component has none, the others are whitened.
    flat = whitening.whitened(frame(spark, [[float(i), 1.0] for i in range(50)])).collect()
    assert {(r.component, r.whitened is None, r.explained) for r in flat} == {(1, False, 1.0), (2, True, 0.0)}
    assert max(r.identity_error for r in flat) < 1e-9
    # Entries beyond a long.
    far = whitening.whitened(frame(spark, [[1e30, 1.0], [-1e30, 2.0], [0.0, 3.0]])).collect()
    assert {r.vec_id for r in far} == {0, 1, 2} and far[0].deviation is None
