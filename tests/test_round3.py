"""Cases behind the fixes of the third round."""

import duckdb
import pytest

import __spark_entry__ as entry
from tabmill.operators import models
from tests.conftest import SF001
from tools.check import _rows


def test_lloyd_runs_until_rows_settle(spark):
    xs = [float(i * i) for i in range(200)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, x double")
    got = {r["id"]: r["cluster"] for r in models.kmeans_fixed(df, ["x"], [[xs[0]], [xs[1]]]).collect()}
    mean = [sum(v) / len(v) for v in ([x for i, x in enumerate(xs) if got[i] == j] for j in (0, 1))]
    assert all(got[i] == int(abs(x - mean[1]) < abs(x - mean[0])) for i, x in enumerate(xs))
    cut = {r["id"]: r["cluster"] for r in models.kmeans_fixed(df, ["x"], [[xs[0]], [xs[1]]], iters=3).collect()}
    assert cut != got


@pytest.mark.parametrize("name", ["kmeans_settled", "cluster_profile_settled", "knn_grid_full"])
def test_whole_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    got, want = entry.queries()[name](spark, SF001), con.sql(entry.oracle_sql()[name])
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())
