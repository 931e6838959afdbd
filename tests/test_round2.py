"""Cases behind the fixes of the second round."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabmill.functions.pvalues import chi2_sf
from tabmill.operators import assoc, impute, models
from tabmill.operators.ordering import exact_quantiles
from tabmill.sources import snapshot, text


def plain_chi2_sf(stat, dof):
    """The finite sum of Poisson terms (even dof) by logarithms."""
    x = stat / 2
    return min(1.0, math.fsum(math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(dof // 2)))


def test_chi2_tail_for_any_dof(spark):
    cases = [(s, d) for d in (2, 10, 600, 700, 1000, 5000, 90_000) for s in (0.5 * d, d, 1.02 * d, 1.2 * d, 2.0 * d, 3.0 * d + 50)]
    df = spark.createDataFrame([(float(s), d) for s, d in cases], "s double, d int")
    for r in df.select("s", "d", chi2_sf("s", "d").alias("p")).collect():
        assert r["p"] == pytest.approx(plain_chi2_sf(r["s"], r["d"]), abs=1e-8)


def test_small_tails_keep_their_order(spark):
    df = spark.createDataFrame([(60.0,), (80.0,), (120.0,), (300.0,)], "s double")
    p = [r["p"] for r in df.select("s", chi2_sf("s", F.lit(1)).alias("p")).orderBy("s").collect()]
    assert p == pytest.approx([math.erfc(math.sqrt(s / 2)) for s in (60, 80, 120, 300)], rel=1e-8)


def test_chi2_needs_no_grid(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(400), rng.randrange(3)) for _ in range(5000)]
    df = spark.createDataFrame(rows, "a int, b int")
    t = assoc.chi2_test(df, "a", "b").first()
    o = np.zeros((400, 3))
    for a, b in rows:
        o[a, b] += 1
    o = o[o.sum(1) > 0]
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert t["statistic"] == pytest.approx(((o - e) ** 2 / e).sum()) and t["dof"] == (len(o) - 1) * 2


def test_fourier_features_estimate_the_kernel():
    rng, gamma, d = random.Random(9), 0.2, 2000
    w, b = models.rff_weights(5, d, gamma)
    z = lambda x: [math.sqrt(2 / d) * math.cos(sum(p * q for p, q in zip(wj, x)) + bj) for wj, bj in zip(w, b)]
    for _ in range(10):
        x, y = ([rng.gauss(0, 1) for _ in range(5)] for _ in range(2))
        want = math.exp(-gamma * sum((p - q) ** 2 for p, q in zip(x, y)))
        assert abs(sum(p * q for p, q in zip(z(x), z(y))) - want) < 3 / math.sqrt(d)
        assert abs(sum(p * p for p in z(x)) - 1) < 3 / math.sqrt(d)


def test_dummies_stay_with_their_variable(spark):
    df = spark.createDataFrame([(i, i % 3, f"b_{i % 2}", i % 2, float(i)) for i in range(12)], "id long, seg int, seg_b string, seg_b_b int, x double")
    enc, groups = impute.one_hot_groups(df, ["seg", "seg_b", "seg_b_b"])
    assert [len(groups[c]) for c in ("seg", "seg_b", "seg_b_b")] == [3, 2, 2]
    names = [d for g in groups.values() for d in g]
    assert len(set(names)) == 7 and set(names) <= set(enc.columns)
    _, cols, own = models.FeatureSet("s", categorical=("seg", "seg_b")).apply(df, exclude=["id"])
    assert len(cols) == len(set(cols)) == 7 and sorted(own) == ["seg", "seg_b", "seg_b_b", "x"]


def test_quantiles_of_a_hot_value(spark):
    vals = [5.0] * 9000 + [random.Random(3).uniform(0, 10) for _ in range(1000)]
    df = spark.createDataFrame([("k", v) for v in vals], "g string, v double")
    got = exact_quantiles(df, ["g"], "v", {"p01": 0.01, "p50": 0.5, "p97": 0.97}, num_partitions=8).first()
    assert [got[c] for c in ("p01", "p50", "p97")] == pytest.approx(np.quantile(vals, [0.01, 0.5, 0.97]).tolist())


def test_lines_follow_files_and_offsets(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"part{f}.txt").write_text("".join(f"{f}:{i} x\n" for i in range(4000 - 1500 * f)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = [r["value"] for r in text.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert lines == [f"{f}:{i} x" for f in range(3) for i in range(4000 - 1500 * f)]


def test_snapshot_is_built_only_when_missing(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(3).toDF("id")
    path = str(tmp_path / "snap")
    assert snapshot.load_or(spark, path, build).count() == snapshot.load_or(spark, path, build).count() == 3 and made == [1]


def test_imputation_rounds_and_forces_odd_k(spark):
    rng = random.Random(5)
    rows = [(i, float(i % 10), float(rng.randrange(5)), -9.0 if i % 7 == 0 else float(i % 10) * 1.05) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, t double")
    spec = impute.ImputeSpec("t", "reg", round_digits=1, force_odd=True)
    out = impute.knn_impute(df, "id", spec, ["a", "b"], []).collect()
    assert len(out) == len([r for r in rows if r[3] == -9.0])
    assert all(r["prediction"] == round(r["prediction"], 1) for r in out)
