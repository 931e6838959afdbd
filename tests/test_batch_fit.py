"""Batched logistic fits against a plain solver, one fit at a time."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabmill.operators import batch_fit as bf

COLS = ["a", "b", "c"]


def make(n=300, seed=1, weights=(1.5, -0.7, 0.0)):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in COLS]
        z = 0.3 + sum(w * v for w, v in zip(weights, x))
        out.append((i, *x, int(rng.random() < 1 / (1 + math.exp(-z))), i % 4 + 1))
    return out


def plain(rows, cols, cost):
    """Newton steps on the penalised likelihood, in plain numpy."""
    x = np.array([[1.0, *(r[1 + COLS.index(c)] for c in cols)] for r in rows])
    y = np.array([r[4] for r in rows], float)
    ridge = np.full(x.shape[1], 0.0 if cost is None else 1.0 / cost)
    ridge[0] = 0.0
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return w


@pytest.fixture(scope="module")
def data(spark):
    rows = make()
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label int, fold int")
    return rows, bf.table(df, "id", "label", COLS, bf.fold_bits("fold", 4))


def test_all_fits_equal_plain_ones(data):
    rows, table = data
    fits = [bf.Fit(f"{len(c)}:{cost}", c, cost, part) for c in [("a",), ("c", "a"), ("a", "b", "c"), ()] for cost in (None, 0.05, 2.0) for part in (1, 4)]
    for f in bf.fit_all(table, COLS, fits):
        train = [r for r in rows if r[5] != f.fit.part]
        assert f.converged and f.n == len(train)
        assert np.allclose([f.coef[c] for c in ("", *f.fit.columns)], plain(train, f.fit.columns, f.fit.cost), atol=1e-6)


def test_scores_come_from_the_other_folds(data):
    rows, table = data
    fitted = bf.fit_all(table, COLS, [bf.Fit("m", ("a", "b"), 1.0, f) for f in (1, 2, 3, 4)])
    got = {r["id"]: r for r in bf.out_of_part(table, COLS, fitted).collect()}
    assert len(got) == len(rows)
    for r in rows:
        w = plain([t for t in rows if t[5] != r[5]], ("a", "b"), 1.0)
        assert got[r[0]]["part"] == r[5] and got[r[0]]["p"] == pytest.approx(1 / (1 + math.exp(-(w[0] + w[1] * r[1] + w[2] * r[2]))), abs=1e-7)
    share = np.mean([np.mean([(got[r[0]]["p"] > 0.5) == r[4] for r in rows if r[5] == f]) for f in (1, 2, 3, 4)])
    assert bf.accuracy(bf.out_of_part(table, COLS, fitted)).first()["accuracy"] == pytest.approx(share)


def test_separable_classes_do_not_converge_without_a_penalty(spark):
    df = spark.createDataFrame([(i, float(i), int(i > 5)) for i in range(12)], "id long, a double, label int")
    table = bf.table(df, "id", "label", ["a"], F.lit(1))
    free, held = bf.fit_all(table, ["a"], [bf.Fit("free", ("a",), None), bf.Fit("held", ("a",), 1.0)], steps=12)
    assert not free.converged and held.converged


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (2, None, 0), (3, float("nan"), 1), (4, 2.0, None), (5, -1.0, 0), (6, 0.5, 0)], "id long, a double, label int")
    table = bf.table(df, "id", "label", ["a"], F.lit(1))
    assert bf.fit_all(table, ["a"], [bf.Fit("m", ("a",))])[0].n == 3
    none = bf.fit_all(bf.table(df.limit(0), "id", "label", ["a"], F.lit(1)), ["a"], [bf.Fit("m", ("a",))])[0]
    assert none.n == 0 and none.coef == {"": 0.0, "a": 0.0}
    assert bf.out_of_part(table, ["a"], [none]).count() == 0


def test_score_tests_find_the_planted_order(spark):
    rows = make(1500, 7, (0.5, 1.6, 0.0))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label int, fold int").withColumn("d", F.col("b") * 2)
    table = bf.table(df, "id", "label", [*COLS, "d"], F.lit(1))
    path = bf.forward_by_score(table, [*COLS, "d"], {"a": ["a"], "c": ["c"], "bd": ["b", "d"]}, 0.001)
    assert [p[0] for p in path] == ["bd", "a"] and all(p[2] < 0.001 for p in path)
    y = np.array([r[4] for r in rows], float)
    x = np.array([r[2] for r in rows])
    mean = y.mean()
    g = (x * (mean - y)).sum()
    assert path[0][1] == pytest.approx(g * g / (mean * (1 - mean) * ((x - x.mean()) ** 2).sum()), rel=1e-6)
