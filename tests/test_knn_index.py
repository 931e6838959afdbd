"""The k-d tree index against brute force: outliers, equal rows, many features, edge inputs."""

import random

import numpy as np
import pytest

from tabmill.operators import knn, knn_index


def brute(qs, ts, k):
    out = {}
    for i, x in qs:
        if None in x:
            continue
        ranked = sorted((round(float(np.sqrt(np.square(np.subtract(x, y)).sum())), 9), j) for j, y in ts if None not in y)
        out[i] = [(r, j) for r, (_, j) in enumerate(ranked[:k], 1)]
    return {i: v for i, v in out.items() if v}


def check(spark, qs, ts, k, **how):
    n = len(ts[0][1] if ts else qs[0][1])
    cols = ", ".join(f"f{d} double" for d in range(n))
    make = lambda rows: spark.createDataFrame([(i, *x) for i, x in rows], f"id long, {cols}")
    got = {}
    for r in knn.knn_join(make(qs), make(ts), [f"f{d}" for d in range(n)], k, **how).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["tid"]))
    assert {i: sorted(v) for i, v in got.items()} == brute(qs, ts, k)


def rows(rng, n, d, start=0):
    return [(start + i, [rng.gauss(0, 1) for _ in range(d)]) for i in range(n)]


def test_outlier_and_many_leaves(spark):
    rng = random.Random(1)
    ts = rows(rng, 1500, 3) + [(5000, [1e9, -1e9, 0.0])]
    check(spark, rows(rng, 40, 3, 9000) + [(9900, [1e9, 0.0, 0.0])], ts, 7, leaf_rows=60)


def test_ninety_percent_equal_rows(spark):
    rng = random.Random(2)
    ts = [(i, [1.0, 2.0]) if i % 10 else (i, [rng.random(), rng.random() * 3]) for i in range(1200)]
    check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.1]), (3, [0.2, 0.2]), (4, [-50.0, 9.0])], ts, 15, leaf_rows=30)


def test_twenty_features_with_one_hot_columns(spark):
    rng = random.Random(3)
    make = lambda n, s: [(s + i, x + [3.0 * (lv == j) for j in range(8)]) for i in range(n)
                         for x, lv in [([rng.gauss(0, 1) for _ in range(12)], rng.choice([0, 0, 0, 1, 2, 7]))]]
    check(spark, make(30, 9000), make(900, 0), 5, leaf_rows=40)


def test_parts_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(knn_index, "PART", 50)
    monkeypatch.setattr(knn_index, "CHUNK", 7)
    rng = random.Random(4)
    check(spark, rows(rng, 60, 2, 9000), rows(rng, 700, 2), 9, leaf_rows=200)


def test_grid_of_ties(spark):
    ts = [(i, [float(i % 20), float(i // 20 % 20)]) for i in range(800)]
    check(spark, [(1, [5.0, 5.0]), (2, [5.5, 5.5]), (3, [0.0, 19.0])], ts, 6, leaf_rows=25)


@pytest.mark.parametrize("k", [1, 50])
def test_few_rows_nulls_and_empty_sides(spark, k):
    ts = [(1, [0.0, 1.0]), (2, [None, 1.0]), (3, [4.0, 4.0]), (4, [0.0, 1.0])]
    check(spark, [(1, [0.0, 0.0]), (2, [None, 0.0])], ts, k)
    check(spark, [(1, [0.0, 0.0])], [], k)
    check(spark, [], ts, k)


def test_tree_places_every_row_inside_its_split(spark):
    x = np.random.default_rng(5).normal(size=(5000, 4))
    x[:4000] = x[0]
    tree = knn_index.grow(x, 100)
    leaf = tree.place(x)
    sizes = np.bincount(leaf, minlength=tree.leaves)
    assert sizes.sum() == 5000 and sorted(sizes)[-2] <= 100 and sizes.max() <= 4100


def check_sums(spark, qs, ts, k, **how):
    """Sums against the neighbours' rows of the join, as mean and as vote."""
    n = len(qs[0][1])
    cols = ", ".join(f"f{d} double" for d in range(n))
    feats = [f"f{d}" for d in range(n)]
    q = spark.createDataFrame([(i, *x) for i, x in qs], f"id long, {cols}")
    t = spark.createDataFrame([(i, *x, (i * 7 + 3) % 5, (i * 13 % 101) / 7.0) for i, x in ts], f"id long, {cols}, c int, y double")
    nb = knn.knn_join(q, t, feats, k, carry=["c", "y"], out_q="id", **how).cache()
    want = {r["id"]: r["prediction"] for r in knn.weighted_mean(nb, "id", "y").collect()}
    got = {r["id"]: r["prediction"] for r in knn.mean_of_sums(knn.knn_sums(q, t, feats, k, "y", **how), "id").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)
    want = {r["id"]: r["prediction"] for r in knn.vote(nb, "id", "c").collect()}
    got = {r["id"]: r["prediction"] for r in knn.vote_of_sums(knn.knn_sums(q, t, feats, k, "c", by_value=True, **how), "id", "c").collect()}
    assert got == want


def test_sums_outlier_nulls_and_parts(spark, monkeypatch):
    for name, value in (("BIN", 150), ("SUM_CHUNK", 7), ("LAST", 2)):
        monkeypatch.setattr(knn_index, name, value)
    rng = random.Random(11)
    ts = rows(rng, 900, 3) + [(5000, [1e9, -1e9, 0.0]), (5001, [None, 0.0, 0.0])]
    qs = rows(rng, 30, 3, 9000) + [(9900, [1e9, 0.0, 0.0]), (9901, [0.0, None, 1.0]), (9902, ts[5][1])]
    check_sums(spark, qs, ts, 31, leaf_rows=60)


def test_sums_of_equal_rows_small_sample_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(knn_index, "SAMPLE", 100)
    rng = random.Random(12)
    ts = [(i, [1.0, 2.0]) if i % 10 else (i, [rng.random(), rng.random() * 3]) for i in range(800)]
    qs = [(1, [1.0, 2.0]), (2, [1.0, 2.1]), (3, [0.2, 0.2]), (4, [-50.0, 9.0])]
    check_sums(spark, qs, ts, 15, leaf_rows=30)
    check_sums(spark, qs, ts[:6], 15)


def test_sums_hand_on_fewer_rows_than_neighbours(spark, monkeypatch):
    seen = []
    cut = knn_index.cut_lineage
    monkeypatch.setattr(knn_index, "cut_lineage", lambda df, *a: (seen.append(out := cut(df, *a)), out)[1])
    rng = random.Random(13)
    qs, ts = rows(rng, 20, 2, 9000), rows(rng, 3000, 2)
    q = spark.createDataFrame([(i, *x) for i, x in qs], "id long, a double, b double")
    t = spark.createDataFrame([(i, *x, 1.0) for i, x in ts], "id long, a double, b double, y double")
    knn.mean_of_sums(knn.knn_sums(q, t, ["a", "b"], 800, "y"), "id").collect()
    assert max(d.count() for d in seen) <= len(ts)  # the join wrote 20 * 800 rows


def test_grid_in_one_pass_as_single_votes(spark):
    rng = random.Random(14)
    qs = [(100 + i, 7 * i + 1) for i in range(12)]
    held = [(q, r, 0.0 if q % 4 == 0 and r < 4 else round(0.1 * r + rng.random() / 50, 6), rng.choice([0, 1, 2]))
            for q, _ in qs for r in range(1, 10)]
    nb = spark.createDataFrame(held, "id long, rank int, dist double, y int")
    truth = spark.createDataFrame([(q, x % 3) for q, x in qs], "id long, truth int")
    grid = [(k, w) for k in (1, 4, 9) for w in ("uniform", "distance")]
    want = {}
    for k, w in grid:
        p = knn.vote(nb.where(f"rank <= {k}"), "id", "y", weights=w).join(truth, "id").collect()
        want[k, w] = pytest.approx(sum(r["prediction"] == r["truth"] for r in p) / len(p))
    got = {(r["k"], r["weights"]): r["accuracy"] for r in knn.grid_accuracy(nb, truth, "id", "y", grid).collect()}
    assert got == want


def test_join_is_not_searched_again_by_its_callers(spark):
    rng = random.Random(15)
    make = lambda x: spark.createDataFrame([(i, *v) for i, v in x], "id long, a double, b double")
    nb = knn.knn_join(make(rows(rng, 40, 2, 9000)), make(rows(rng, 900, 2)), ["a", "b"], 7, leaf_rows=30)
    assert "FlatMapCoGroupsInPandas" not in nb._jdf.queryExecution().toString()
