"""Cases behind the fixes of the fourth round."""

import duckdb
import numpy as np

import __spark_entry__ as entry
from tabmill.plans import q_knn
from tabmill.plans.inputs import study
from tests.conftest import SF001
from tools.check import _rows

GRID = [(k, w) for k in range(9, 46, 2) for w in ("uniform", "distance")]


def _plain(rows, k, weights):
    """Test accuracy of one grid cell, row by row."""
    x = np.array([[float(r[c]) for c in q_knn.CLS_FEATS] for r in rows])
    y, ids = np.array([r["label"] for r in rows]), np.array([r["id"] for r in rows])
    train = ids % 100 < 67
    spread = x[train].std(axis=0)
    x = x / np.where(spread == 0, 1.0, spread)
    right = []
    for q in np.flatnonzero(~train):
        d = np.sqrt(np.square(x[train] - x[q]).sum(axis=1))
        near = np.lexsort((ids[train], np.round(d, 9)))[:k]
        d, votes = d[near], y[train][near]
        w = np.ones(k) if weights == "uniform" else (d == 0).astype(float) if (d == 0).any() else 1.0 / d
        total = {v: w[votes == v].sum() for v in sorted(set(votes))}
        right.append(max(total, key=total.get) == y[q])
    return round(float(np.mean(right)), 6)


def test_knn_grid_runs_every_k_of_the_search(spark):
    got = entry.queries()["knn_grid"](spark, SF001).collect()
    assert sorted((r["k"], r["weights"]) for r in got) == sorted(GRID)
    rows = study(spark, SF001).collect()
    assert {(r["k"], r["weights"]): r["accuracy"] for r in got} == {(k, w): _plain(rows, k, w) for k, w in GRID}


def test_knn_grid_sql_has_the_whole_grid(spark):
    con = duckdb.connect()
    for t in ("customer", "orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    got, want = entry.queries()["knn_grid"](spark, SF001), con.sql(entry.oracle_sql()["knn_grid"])
    assert len(want.fetchall()) == len(GRID)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())
