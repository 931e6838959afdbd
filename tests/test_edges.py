"""Literal edge fixtures (FIXTURES.md section 4) and operator properties."""

import math

import pytest
from pyspark.sql import functions as F

from tabmill.functions import scalars
from tabmill.functions.pvalues import chi2_sf
from tabmill.operators import assoc, evaluate as ev, frame, knn, profile
from tabmill.operators.ordering import exact_quantiles, row_index, running_sums


def _table(spark, cells):
    """Rows (a, b) repeated by count: [[n00, n01], [n10, n11]] etc."""
    rows = [(i, j) for i, r in enumerate(cells) for j, n in enumerate(r) for _ in range(n)]
    return spark.createDataFrame(rows, "a int, b int")


def test_chi2_yates_and_plain(spark):
    df = _table(spark, [[30, 10], [15, 25]])
    y = assoc.chi2_test(df, "a", "b", yates=True).first()
    n = assoc.chi2_test(df, "a", "b", yates=False).first()
    assert y["dof"] == 1 and round(y["statistic"], 4) == 9.9556
    assert round(n["statistic"], 4) == 11.4286
    assert abs(n["p_value"] - math.erfc(math.sqrt(11.4285714 / 2))) < 1e-6


def test_chi2_zero_cell_counted(spark):
    df = _table(spark, [[10, 5], [0, 7], [3, 3]])
    full = assoc.contingency(df, "a", "b").orderBy("a", "b").collect()
    assert len(full) == 6
    zero = [r for r in full if r["a"] == 1 and r["b"] == 0][0]
    assert zero["observed"] == 0 and zero["expected"] == pytest.approx(7 * 13 / 28)
    st = assoc.chi2_test(df, "a", "b").first()
    exp = sum((r["observed"] - r["expected"]) ** 2 / r["expected"] for r in full)
    assert st["statistic"] == pytest.approx(exp) and st["dof"] == 2


def test_chi2_sf_matches_closed_forms(spark):
    df = spark.createDataFrame([(x, d) for x in (0.5, 3.84, 10.0, 40.0) for d in (1, 2, 3, 4, 7)],
                               "x double, d int")
    for r in df.select("x", "d", chi2_sf("x", "d").alias("p")).collect():
        x, d, p = r
        if d == 1:
            ref = math.erfc(math.sqrt(x / 2))
        elif d == 2:
            ref = math.exp(-x / 2)
        elif d == 4:
            ref = math.exp(-x / 2) * (1 + x / 2)
        elif d == 3:
            ref = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        else:
            continue
        assert p == pytest.approx(ref, abs=1e-9)


def test_odds_risk_ratio(spark):
    t = assoc.table2x2(_table(spark, [[30, 10], [15, 25]]).withColumnsRenamed({"a": "e", "b": "o"}), "e", "o").first()
    # rows exposure 0/1, columns outcome 0/1: a=30 b=10 c=15 d=25
    assert t["odds_ratio"] == pytest.approx(30 * 25 / (10 * 15))
    assert t["risk_ratio"] == pytest.approx((25 / 40) / (10 / 40))


def test_odds_ratio_zero_cell_adds_half(spark):
    t = assoc.table2x2(_table(spark, [[5, 0], [3, 4]]).withColumnsRenamed({"a": "e", "b": "o"}), "e", "o").first()
    assert t["cell_b"] == 0.5 and t["odds_ratio"] == pytest.approx(5.5 * 4.5 / (0.5 * 3.5))


def test_alpha_rule(spark):
    df = spark.createDataFrame([(100,), (1000,), (2000,)], "n long")
    vals = [r[0] for r in df.select(assoc.alpha_by_n(F.col("n"))).collect()]
    assert vals[0] == pytest.approx(0.001) and vals[1] == pytest.approx(0.0003) and vals[2] == pytest.approx(1e-4)


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(F.bround("x", 0)).collect()] == [0.0, 2.0, 2.0]
    k = spark.createDataFrame([(6,), (42,), (2,)], "n long").select(scalars.k_of_n(F.col("n")),
                                                                    scalars.k_of_n(F.col("n"), True)).collect()
    assert [tuple(r) for r in k] == [(2, 1), (6, 5), (1, 1)]


def test_equal_width_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 2, 2.1, 10)], "x double")
    out = profile.equal_width_bins(df, "x", 5).orderBy("x").collect()
    assert [r["x_binned"] for r in out] == ["0", "0", "1", "4"]


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x), 0) for x in range(11)], "x double, g int")
    h = {r["bin"]: r["n"] for r in profile.histogram(df, "x", "g", 10).collect()}
    assert h[9] == 2 and sum(h.values()) == 11 and len(h) == 10


def test_mode_lowest_of_ties(spark):
    df = spark.createDataFrame([(2,), (1,), (1,), (2,)], "v int")
    assert profile.mode_of(df, "v").first()[0] == 1


def test_exact_quantiles_match_percentile(spark):
    df = spark.range(0, 1001).select((F.col("id") % 7).alias("g"), ((F.col("id") * 37) % 101).cast("double").alias("x"))
    q = {r["g"]: r for r in exact_quantiles(df, ["g"], "x", {"p25": 0.25, "p50": 0.5}).collect()}
    ref = {r["g"]: r for r in df.groupBy("g").agg(F.percentile("x", 0.25).alias("p25"),
                                                  F.percentile("x", 0.5).alias("p50")).collect()}
    for g in ref:
        assert q[g]["p25"] == pytest.approx(ref[g]["p25"]) and q[g]["p50"] == pytest.approx(ref[g]["p50"])


def test_running_sums_equal_window_with_hot_group(spark):
    # one group holds most rows: still numbered correctly across partitions
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 3).alias("g"),
                                     F.col("id").alias("k"), (F.col("id") % 13).alias("v"))
    got = running_sums(df, ["k"], {"s": F.col("v")}, group=["g"], num_partitions=16)
    from pyspark.sql import Window
    ref = df.withColumn("s_ref", F.sum("v").over(Window.partitionBy("g").orderBy("k")))
    bad = got.join(ref, ["g", "k", "v"]).where(F.col("s") != F.col("s_ref")).count()
    assert bad == 0 and got.count() == 5000
    pos = row_index(df, ["k"], "pos", num_partitions=16)
    assert pos.where(F.col("pos") != F.col("k")).count() == 0


def test_dedupe_ids(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0), (3, 3, 0.0), (3, 4, 0.0), (3, 5, 0.0), (7, 6, 0.0)],
                               "id long, seq long, v double")
    out = {r["seq"]: r["id"] for r in frame.dedupe_ids(df, "id", ["seq"]).collect()}
    assert out == {1: 1, 2: 8, 3: 3, 4: 9, 5: 10, 6: 7}


def test_dedupe_ids_hot_id(spark):
    """One id holds most rows: they lie in several slices, and are numbered as one window numbers them."""
    data = [(5 if i % 10 else 100 + i % 7 * 10 + i // 100, i) for i in range(600)]
    df = spark.createDataFrame(data, "id long, seq long")
    out = {r["seq"]: r["id"] for r in frame.dedupe_ids(df, "id", ["seq"]).collect()}
    seen, top, want = set(), max(i for i, _ in data), {}
    counts = {i: sum(x == i for x, _ in data) for i, _ in data}
    for i, seq in sorted(data):
        if counts[i] > 1 and i in seen:
            top += 1
            want[seq] = top
        else:
            want[seq] = i
        seen.add(i)
    assert out == want and len(set(out.values())) == len(data)


def test_cutoff_strict_and_null_precision(spark):
    s = spark.createDataFrame([(1, "m_1", 0.5, 1), (2, "m_1", 0.2, 0)], "id long, model string, p double, label int")
    sw = {round(r["cut_off"], 3): r for r in ev.cutoff_sweep(s).collect()}
    assert sw[0.5]["true_positives"] == 0 and sw[0.5]["false_negatives"] == 1   # p > c is strict
    assert sw[0.499]["true_positives"] == 1
    assert sw[0.9]["precision"] is None                                          # nothing predicted positive
    assert len(sw) == 1010


def test_sweep_properties(spark):
    s = spark.range(0, 2000).select(F.col("id"), F.lit("a_1").alias("model"),
                                    ((F.col("id") * 7919 % 1000) / 1000.0).alias("p"),
                                    (F.col("id") % 3 == 0).cast("int").alias("label"))
    rows = sorted(ev.cutoff_sweep(s).collect(), key=lambda r: r["cut_idx"])
    assert all(r["true_negatives"] + r["false_positives"] + r["false_negatives"] + r["true_positives"] == 2000
               for r in rows)
    assert all(a["true_positives"] >= b["true_positives"] for a, b in zip(rows, rows[1:]))


def test_winner_rule_fewest_variables(spark):
    runs = spark.createDataFrame([("logit", "logit_1", 0.8, 3), ("logit", "logit_2", 0.8, 2),
                                  ("logit", "logit_3", 0.7, 1)], "model_type string, model string, f1_score double, n_vars int")
    assert ev.pick_winner(runs).first()["model"] == "logit_2"


def test_vote_majority(spark):
    sc = spark.createDataFrame([(1, "a_1", 0.9, 1), (1, "b_1", 0.1, 1), (1, "c_1", 0.9, 1)],
                               "id long, model string, p double, label int")
    chosen = spark.createDataFrame([("a_1", 500), ("b_1", 500), ("c_1", 500)], "model string, cut_idx long")
    v = {r["models"]: r for r in ev.vote_search(sc, chosen, (1, 3)).collect()}
    assert v["a_1, b_1, c_1"]["true_positives"] == 1       # votes 1, 0, 1 -> 1
    assert v["b_1"]["false_negatives"] == 1


def test_date_repair_and_build(spark):
    df = spark.createDataFrame([(1, 86, 2, 30), (2, 99, 12, 31), (3, 5, 1, 2)], "id int, yr int, mo int, day int")
    fixed = frame.update_where(df, (F.col("yr") == 86) & (F.col("mo") == 2) & (F.col("day") == 30),
                               {"mo": 3, "day": 1})
    out = {r["id"]: r["d"] for r in fixed.select("id", scalars.iso_date(scalars.ymd("yr", "mo", "day")).alias("d"))
           .collect()}
    assert out == {1: "1986-03-01", 2: "1999-12-31", 3: "2005-01-02"}


def test_stratified_folds_partition_rows(spark):
    df = spark.range(0, 103).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    f = ev.stratified_folds(df, "y", "id", 5)
    assert f.count() == 103 and f.select("id").distinct().count() == 103
    sizes = {(r["y"], r["fold"]): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        s = [sizes[(y, k)] for k in range(1, 6)]
        assert max(s) - min(s) <= 1 and s == sorted(s, reverse=True)


def test_roc_ends_at_one(spark):
    s = spark.range(0, 500).select(F.col("id"), F.lit("m_1").alias("model"),
                                   ((F.col("id") * 13 % 97) / 97.0).alias("p"),
                                   (F.col("id") % 2).cast("int").alias("label"))
    r = ev.roc_points(s).orderBy(F.col("threshold").desc()).collect()
    assert r[-1]["tpr"] == 1.0 and r[-1]["fpr"] == 1.0
    assert all(a["tps"] <= b["tps"] for a, b in zip(r, r[1:]))


def test_knn_zero_distance_takes_all_weight(spark):
    nb = spark.createDataFrame([(1, 10, 0.0, 1, 0), (1, 11, 0.5, 2, 1), (1, 12, 0.6, 3, 1)],
                               "qid long, tid long, dist double, rank int, y int")
    assert knn.vote(nb, "qid", "y").first()["prediction"] == 0
    assert knn.weighted_mean(nb, "qid", "y").first()["prediction"] == 0.0


def test_knn_tie_lowest_label(spark):
    nb = spark.createDataFrame([(1, 10, 1.0, 1, 1), (1, 11, 1.0, 2, 0)], "qid long, tid long, dist double, rank int, y int")
    assert knn.vote(nb, "qid", "y").first()["prediction"] == 0


def test_knn_join_equals_brute_force_with_hot_cell(spark):
    # a third of the training rows sit on one point (a hot cell), queries
    # scattered, two features; compare with brute force in Python
    import random
    rnd = random.Random(7)
    train = [(i, 0.5, 0.5, 1.0) for i in range(300)] + \
            [(300 + i, rnd.uniform(-5, 5), rnd.uniform(-5, 5), rnd.uniform(0, 1)) for i in range(600)]
    queries = [(i, rnd.uniform(-6, 6), rnd.uniform(-6, 6), rnd.uniform(0, 1)) for i in range(60)] + [(99, 0.5, 0.5, 1.0)]
    tdf = spark.createDataFrame(train, "id long, x double, y double, z double")
    qdf = spark.createDataFrame(queries, "id long, x double, y double, z double")
    k = 7
    got = knn.knn_join(qdf, tdf, ["x", "y", "z"], k, salt=3).collect()
    res = {}
    for r in got:
        res.setdefault(r["qid"], []).append((r["rank"], r["tid"]))
    for qid, qx, qy, qz in queries:
        d = sorted((round(math.dist((qx, qy, qz), (tx, ty, tz)), 9), tid) for tid, tx, ty, tz in train)[:k]
        assert [t for _, t in sorted(res[qid])] == [t for _, t in d]


def test_knn_join_with_one_hot_blocks_equals_brute_force(spark):
    # continuous x, y plus a z-scored one-hot block: the restricted search
    # (same category first) must give exactly the brute-force neighbours
    import random
    from tabmill.operators.dist import zscore
    from tabmill.operators.impute import one_hot
    rnd = random.Random(11)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.choice([0, 1, 1, 2, 3]), int(i % 17 == 0)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, x double, y double, c int, is_q int")
    enc, dummies = one_hot(df, ["c"])
    feats = ["x", "y", *dummies]
    z = zscore(enc, feats, train=F.col("is_q") == 0)
    tr, qs = z.where("is_q = 0"), z.where("is_q = 1")
    k = 9
    got = knn.knn_join(qs, tr, feats, k, blocks=[dummies], salt=2).collect()
    res = {}
    for r in got:
        res.setdefault(r["qid"], []).append((r["rank"], r["tid"]))
    tl = [(r["id"], [r[f] for f in feats]) for r in tr.collect()]
    for r in qs.collect():
        qv = [r[f] for f in feats]
        d = sorted((round(math.dist(qv, tv), 9), tid) for tid, tv in tl)[:k]
        assert [t for _, t in sorted(res[r["id"]])] == [t for _, t in d]


def test_knn_join_without_queries(spark):
    tr = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 0.0)], "id long, x double, y double")
    out = knn.knn_join(tr.limit(0), tr, ["x", "y"], 1)
    assert out.count() == 0 and out.columns == ["qid", "tid", "dist", "rank"]
