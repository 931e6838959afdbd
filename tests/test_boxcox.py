"""Box-Cox lambda by Newton steps against a plain search."""

import math
import random

import numpy as np
import pytest

from tabmill.operators import dist


def plain(xs):
    x = np.array([v for v in xs if v is not None], float)
    u = np.log(x) - np.log(x).mean()

    def spread(lam):
        return np.var(u if lam == 0 else np.expm1(lam * u) / lam)
    best = 0.0
    for step in (1.0, 0.1, 0.01, 0.001):
        while True:
            near = min((best - step, best, best + step), key=lambda lam: spread(round(lam, 9)))
            if near == best:
                break
            best = round(near, 9)
    return best


def cases():
    rng = random.Random(3)
    yield "lognormal", [math.exp(rng.gauss(2, 1)) for _ in range(400)]
    yield "normal", [rng.gauss(50, 5) for _ in range(400)]
    yield "square", [rng.uniform(1, 9) ** 2 for _ in range(400)]
    yield "steep", [rng.uniform(0.9, 1.0) ** (1 / 12) for _ in range(400)]
    yield "heavy", [1 / rng.uniform(0.001, 1) for _ in range(400)]
    yield "two", [1.0] * 90 + [2.0] * 310
    yield "close", [1000.0 + k % 7 for k in range(400)]
    yield "wide", [10.0 ** rng.uniform(-30, 30) for _ in range(399)] + [None]


def test_lambda_matches_a_plain_search(spark):
    data = dict(cases())
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{k} double" for k in data))
    got = {r["variable"]: r for r in dist.boxcox_lambda(df, list(data)).collect()}
    for k, xs in data.items():
        assert got[k]["n"] == sum(v is not None for v in xs) and got[k]["positive"] == 1
        assert got[k]["bc_lambda"] == pytest.approx(plain(xs), abs=1e-3), k


def test_columns_without_a_lambda(spark):
    df = spark.createDataFrame([(5.0, 0.0, -1.0, None, 2.0)] * 3 + [(5.0, 1.0, 2.0, None, 3.0)], "one double, zero double, negative double, none double, good double")
    got = {r["variable"]: (r["n"], r["positive"], r["bc_lambda"] is None) for r in dist.boxcox_lambda(df, df.columns).collect()}
    assert got["one"] == (4, 1, True) and got["zero"] == (4, 0, True) and got["negative"] == (4, 0, True) and got["good"] == (4, 1, False)
    assert dist.boxcox_lambda(df.limit(0), ["one"]).count() == 0
