"""Kernel classifiers against a plain dual solver on the whole kernel matrix."""

import math
import random

import numpy as np
import pytest

from tabmill.operators import batch_fit as bf
from tabmill.operators import kernel as kn

COLS = ["a", "b"]


def make(n=90, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in COLS]
        out.append((i, *x, int(x[0] ** 2 + x[1] ** 2 + 0.6 * rng.gauss(0, 1) > 1.2), i % 3 + 1))
    return out


def plain(x, y, k, cost):
    """Dual by the most violating pair: decision function on the training rows and others by kernel rows."""
    a, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(200_000):
        up = ((y > 0) & (a < cost - 1e-12)) | ((y < 0) & (a > 1e-12))
        low = ((y > 0) & (a > 1e-12)) | ((y < 0) & (a < cost - 1e-12))
        v = -y * g
        i, j = np.where(up, v, -np.inf).argmax(), np.where(low, v, np.inf).argmin()
        if v[i] - v[j] < 1e-9:
            break
        t = (v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        t = min(t, cost - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else cost - a[j])
        a[i] += y[i] * t
        a[j] -= y[j] * t
        g += t * y * (k[:, i] - k[:, j])
    free = (a > 1e-9) & (a < cost - 1e-9)
    assert free.any()
    return a * y, float((-y * g)[free].mean())


@pytest.fixture(scope="module")
def data(spark):
    rows = make()
    df = spark.createDataFrame(rows, "id long, a double, b double, label int, fold int")
    return rows, bf.table(df, "id", "label", COLS, bf.fold_bits("fold", 3))


def test_decisions_equal_dual(data):
    rows, table = data
    marks = kn.landmarks(table, 1000)
    assert len(marks) == len(rows)
    fits = [kn.Svc(f"{g}:{c}", "rbf", g, c, part) for g, c in ((0.3, 5.0), (1.0, 0.5)) for part in (1, 2)]
    fitted = kn.fit_all(table, fits, marks)
    assert all(f.converged for f in fitted)
    got = {(r["id"], r["model"], r["part"]): r["decision"] for r in kn.out_of_part(table, fitted).collect()}
    for f in fits:
        train, test = [r for r in rows if r[4] != f.part], [r for r in rows if r[4] == f.part]
        x, y = np.array([r[1:3] for r in train]), np.array([1.0 if r[3] else -1.0 for r in train])
        a, b = plain(x, y, kn.kernel_values("rbf", f.gamma, x, x), f.cost)
        want = kn.kernel_values("rbf", f.gamma, np.array([r[1:3] for r in test]), x) @ a + b
        for r, d in zip(test, want):
            assert math.isclose(got[(r[0], f.name, f.part)], d, abs_tol=1e-3)
    assert len(got) == sum(sum(r[4] == f.part for r in rows) for f in fits)


def test_few_landmarks_and_sigmoid(data):
    """With fewer landmarks than rows, and with the sigmoid kernel, a ring is or isn't told apart as it should be."""
    rows, table = data
    marks = kn.landmarks(table, 30)
    fits = [kn.Svc(k, k, g, 10.0, p) for k, g in (("rbf", 0.5), ("sigmoid", 0.2)) for p in (1, 2, 3)]
    fitted = kn.fit_all(table, fits, marks)
    right = {r["model"]: r["accuracy"] for r in kn.accuracy(kn.out_of_part(table, fitted)).collect()}
    assert right["rbf"] > 0.8 > right["sigmoid"]  # a ring is no matter of one direction


def test_linear_classes_and_repeats(spark):
    """Repeated rows (a landmark matrix without full rank), one part that all rows train, separable classes."""
    rows = [(i, float(i % 4), int(i % 4 > 1)) for i in range(40)]
    table = bf.table(spark.createDataFrame(rows, "id long, a double, label int"), "id", "label", ["a"], bf.F.lit(1))
    f, = kn.fit_all(table, [kn.Svc("s", "rbf", 0.5, 100.0)], kn.landmarks(table, 40))
    z = f.basis.features(np.array([[0.0], [1.0], [2.0], [3.0]])) @ f.weights
    assert f.converged and f.n == 40 and (z < 0).tolist() == [True, True, False, False]
    assert abs(z[1] + 1) < 1e-3 and abs(z[2] - 1) < 1e-3


def test_empty_and_nulls(spark):
    none = spark.createDataFrame([], "id long, a double, label int")
    table = bf.table(none, "id", "label", ["a"], bf.F.lit(1))
    assert kn.out_of_part(table, kn.fit_all(table, [], kn.landmarks(table))).count() == 0
    some = spark.createDataFrame([(1, None, 1), (2, float("nan"), 0), (3, 0.5, None), (4, 0.1, 0), (5, 0.9, 1)], none.schema)
    table = bf.table(some, "id", "label", ["a"], bf.F.lit(1))
    assert kn.fit_all(table, [kn.Svc("s")], kn.landmarks(table))[0].n == 2
    with pytest.raises(ValueError):
        kn.basis("cubic", 1.0, np.zeros((1, 1)))
