"""Model queries on MLlib.

Fitted, seeded models are checked rows-only.  Where a closed form exists
the query has an exact oracle: one-hot encodings, the no-intercept logit on
a single 0/1 predictor, random Fourier features from a fixed rule, Lloyd
iterations from fixed centres and the cluster profile built on them.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from tabmill.functions.pvalues import chi2_sf_sql
from tabmill.operators import evaluate as ev
from tabmill.operators import models as md
from tabmill.operators.dist import zscore
from tabmill.operators.impute import one_hot
from tabmill.plans.inputs import STUDY_SQL, study
from tabmill.plans.registry import query
from tabmill.session import cut_lineage

FEATS = ["acctbal", "n_orders", "avg_price", "max_price", "share_f"]


def _r(c, d=6):
    return F.round(c, d)


def _data(spark, sf, with_folds=True):
    """z-scored study features + label (+ stratified folds), assembled."""
    s = study(spark, sf)
    z = zscore(s, FEATS)
    if with_folds:
        z = ev.stratified_folds(z, "label", "id", 5)
    # iterative fits read this table many times: materialise it once
    return cut_lineage(md.assemble(z, FEATS))


# ---- H10 / H11 ----------------------------------------------------------------------------------

@query("one_hot_all", f"""WITH {STUDY_SQL} SELECT id, {", ".join(f"CAST(region = {v} AS INTEGER) AS region_{v}" for v in range(5))},
  CAST(big = 0 AS INTEGER) AS big_0, CAST(big = 1 AS INTEGER) AS big_1 FROM study""")
def one_hot_all(spark, sf):
    """Every level of region and big as a 0/1 column."""
    out, _ = one_hot(study(spark, sf).select("id", "region", "big"), ["region", "big"])
    return out


@query("one_hot_drop_first", f"""WITH {STUDY_SQL} SELECT id, {", ".join(f"CAST(region = {v} AS INTEGER) AS region_{v}" for v in range(1, 5))},
  CAST(big = 1 AS INTEGER) AS big_1 FROM study""")
def one_hot_drop_first(spark, sf):
    """The smallest level dropped (regression design)."""
    out, _ = one_hot(study(spark, sf).select("id", "region", "big"), ["region", "big"], drop_first=True)
    return out


# ---- J4 / J5 / J6 / J3 --------------------------------------------------------------------------

@query("shuffle_split_sets")
def shuffle_split_sets(spark, sf):
    """Five seeded 70/30 splits of the study ids, with train/test sizes
    and the logistic model's test accuracy per split."""
    d = _data(spark, sf, with_folds=False)
    splits = md.shuffle_splits(d, "id", 5, 70, seed=43)
    sizes = splits.groupBy("split").agg(F.sum("is_train").alias("n_train"),
                                        F.sum(1 - F.col("is_train")).alias("n_test"))
    acc = md.shuffle_split_score(LogisticRegression(maxIter=50), d, splits, "id")
    return sizes.join(acc, "split")


def _bucket_sql(seed: str) -> str:
    return f"('0x' || substr(md5(id || ':' || {seed}), 1, 8))::BIGINT % 100"


@query("shuffle_split_members", f"""WITH {STUDY_SQL}
SELECT CAST(split AS INTEGER) AS split, id, CAST({_bucket_sql('(split + 43)')} < 70 AS INTEGER) AS is_train FROM study CROSS JOIN range(0, 5) r(split)""")
def shuffle_split_members(spark, sf):
    """Who is in the training part of each split."""
    return md.shuffle_splits(study(spark, sf).select("id"), "id", 5, 70, seed=43)


@query("hash_split_default", f"""WITH {STUDY_SQL} SELECT id, CAST({_bucket_sql("43")} < 67 AS INTEGER) AS is_train FROM study""")
def hash_split_default(spark, sf):
    """The default split of the ids."""
    return ev.hash_split(study(spark, sf).select("id"), "id")


@query("grid_search")
def grid_search(spark, sf):
    """Accuracy of a logistic model over five 70/30 shuffle splits for a
    grid of costs."""
    found = md.split_search(lambda n, cost: md.logistic(n, cost), md.grid_of(cost=[0.01, 0.1, 1.0, 10.0]), _data(spark, sf, with_folds=False))
    return spark.createDataFrame([(p["cost"], a) for p, a in found], "cost double, accuracy double")


@query("svc_cost_search")
def svc_cost_search(spark, sf):
    """The cost of a linear SVC by accuracy over shuffle splits."""
    found = md.split_search(lambda n, cost: LinearSVC(regParam=1.0 / (cost * n), maxIter=100), md.grid_of(cost=[0.1, 1.0, 10.0]), _data(spark, sf, with_folds=False), n_splits=2)
    return spark.createDataFrame([(p["cost"], a) for p, a in found], "cost double, accuracy double")


@query("logit_oof")
def logit_oof(spark, sf):
    """L2 logistic regression (C = 1), out-of-fold probabilities."""
    return md.oof_predictions(lambda n: md.logistic(n, 1.0), _data(spark, sf), "id")


@query("rfe_ranking")
def rfe_ranking(spark, sf):
    """Recursive feature elimination with logistic weights."""
    return md.rfe_ranking(_data(spark, sf, with_folds=False), FEATS)


_LOGIT_SQL = f"""WITH {STUDY_SQL},
c AS (SELECT count(*) AS n, count_if(big = 1 AND label = 1) AS n11, count_if(big = 1 AND label = 0) AS n10,
             count_if(big = 0) AS n0, avg(label::DOUBLE) AS pbar FROM study),
e AS (SELECT *, ln(n11 / n10::DOUBLE) AS b, sqrt(1.0 / n11 + 1.0 / n10) AS se, n11 / (n11 + n10)::DOUBLE AS p1 FROM c),
f AS (SELECT *, n11 * ln(p1) + n10 * ln(1 - p1) + n0 * ln(0.5) AS ll,
             n * (pbar * ln(pbar) + (1 - pbar) * ln(1 - pbar)) AS null_ll FROM e)
SELECT 'big' AS variable, round(b, 5) AS coef, round(se, 5) AS std_err, round(b / se, 5) AS z,
       round({chi2_sf_sql('(b / se) * (b / se)', '1')}, 5) AS p_value, n, 1 AS k, round(ll, 5) AS ll,
       round(null_ll, 5) AS null_ll, round(1 - ll / null_ll, 5) AS pseudo_r2, round(2 - 2 * ll, 5) AS aic,
       round(ln(n) - 2 * ll, 5) AS bic, true AS converged, round({chi2_sf_sql('2 * (ll - null_ll)', '1')}, 5) AS llr_p_value FROM f"""


@query("logit_inference", _LOGIT_SQL)
def logit_inference(spark, sf):
    """No-intercept logistic regression of the label on the 0/1 high
    balance flag (binomial GLM); the closed form is the oracle."""
    s = study(spark, sf)
    coefs, fit = md.logit_inference(s.withColumn("big", F.col("big").cast("double")), "label", ["big"])
    c = coefs.select("variable", *[_r(F.col(x), 5).alias(x) for x in ("coef", "std_err", "z", "p_value")])
    names = ("ll", "null_ll", "pseudo_r2", "aic", "bic", "llr_p_value")
    f = fit.select(F.struct("n", "k", "converged", *[_r(F.col(x), 5).alias(x) for x in names]).alias("f")).scalar()
    return c.select("*", *[f[x].alias(x) for x in ("n", "k", "converged", *names)])


# The feature sets of the model runs (drop list + categorical list)
FEATURE_SETS = {
    "regression": md.FeatureSet("regression", drop=("seg", "nation", "big"), categorical=("region",), drop_first=True),
    "trees": md.FeatureSet("trees", drop=("seg", "nation", "big"), categorical=("region",)),
}


@query("forward_selection")
def forward_selection(spark, sf):
    """Forward selection on the training part, by rank, with region as
    a dummy group (the regression feature set: first level dropped)."""
    z = zscore(ev.hash_split(study(spark, sf), "id").where("is_train = 1").drop("is_train"), FEATS)
    enc, _, groups = FEATURE_SETS["regression"].apply(z, exclude=["id", "label"])
    enc = cut_lineage(enc)
    ranking = ["avg_price", "region", "acctbal", "n_orders", "share_f", "max_price"]
    return md.forward_select(enc, "label", ranking, {"region": groups["region"]}, alpha=0.04)


# ---- J11 / J12: forests -----------------------------------------------------------------------------

@query("rf_importance")
def rf_importance(spark, sf):
    """Forest grid (trees x impurity x features tried per split) by
    accuracy over shuffle splits, then the best forest's importances."""
    d = _data(spark, sf, with_folds=False)

    def forest(n, **p):
        return RandomForestClassifier(seed=43, maxDepth=4, **p)
    grid = md.grid_of(numTrees=[10, 20], impurity=["gini", "entropy"], featureSubsetStrategy=["sqrt", "all"])
    best = max(md.split_search(forest, grid, d, n_splits=2), key=lambda pa: pa[1])[0]
    return spark.createDataFrame(md.importances(forest(0, **best).fit(d), FEATS), "variable string, importance double")


@query("backward_elimination")
def backward_elimination(spark, sf):
    """Drop the weakest variable group while all its columns are below
    0.01 importance (region as one group of dummies).  A column of one value
    is among the variables; it must fall, and does so first."""
    s = zscore(study(spark, sf), FEATS).withColumn("flat", F.lit(1.0))
    enc, _, groups = FEATURE_SETS["trees"].apply(s, exclude=["id", "label"])
    enc = cut_lineage(enc)
    groups = {v: g for v, g in groups.items() if v in set(FEATS) | {"region", "flat"}}
    return md.backward_eliminate(enc, groups, lambda: RandomForestClassifier(seed=43, numTrees=20, maxDepth=4),
                                 threshold=0.01)


def _planted(spark, sf):
    """The study with a variable that is the label and two of one value."""
    s = study(spark, sf).select("id", F.col("label").cast("double").alias("label"))
    return cut_lineage(s.withColumns({"is_label": F.col("label") * 3, "flat_a": F.lit(1.0), "flat_b": F.lit(2.0)}))


@query("elimination_planted", """SELECT * FROM (VALUES (1, 'flat_a', 0.0::DOUBLE), (2, 'flat_b', 0.0::DOUBLE)) v(step, dropped, importance)""")
def elimination_planted(spark, sf):
    """J12 where the order is known: variables of one value fall, by name;
    the one that is the label stays."""
    groups = {c: [c] for c in ("is_label", "flat_a", "flat_b")}
    return md.backward_eliminate(_planted(spark, sf), groups, lambda: RandomForestClassifier(
        seed=43, numTrees=5, maxDepth=3, featureSubsetStrategy="all"))


@query("importance_planted", """SELECT * FROM (VALUES ('is_label', 1.0::DOUBLE), ('flat_a', 0.0::DOUBLE), ('flat_b', 0.0::DOUBLE)) v(variable, importance)""")
def importance_planted(spark, sf):
    """J11 where the importances are known: they sum to 1, all of it the label's twin."""
    cols = ["is_label", "flat_a", "flat_b"]
    model = RandomForestClassifier(seed=43, numTrees=5, maxDepth=3, featureSubsetStrategy="all", featuresCol="f").fit(
        md.assemble(_planted(spark, sf), cols, "f"))
    return spark.createDataFrame([(c, round(v, 9)) for c, v in md.importances(model, cols)], "variable string, importance double")


# ---- J13 / J14: support vectors -----------------------------------------------------------------------

@query("linear_svc_oof")
def linear_svc_oof(spark, sf):
    """Linear SVC (C = 1, regParam = 1/(C n)), out-of-fold labels."""
    return md.oof_predictions(lambda n: LinearSVC(regParam=1.0 / n, maxIter=100), _data(spark, sf), "id", proba=False)


RFF_D = 64
RFF_GAMMA = 0.2


def _rff_sql() -> str:
    w, b = md.rff_weights(len(FEATS), RFF_D, RFF_GAMMA)
    zs = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in FEATS)
    dots = [" + ".join(f"{w[j][i]!r}::DOUBLE * {c}" for i, c in enumerate(FEATS)) for j in range(RFF_D)]
    cols = ", ".join(f"round(sqrt(2.0 / {RFF_D}) * cos({dots[j]} + {b[j]!r}::DOUBLE), 6) AS rff_{j}" for j in range(RFF_D))
    return f"""WITH {STUDY_SQL},
z AS (SELECT id, {zs} FROM study)
SELECT id, {cols} FROM z"""


def _rff_data(spark, sf):
    s = zscore(study(spark, sf), FEATS)
    return md.rff(s, FEATS, RFF_D, RFF_GAMMA)


@query("rff_features", _rff_sql())
def rff_features(spark, sf):
    """Random Fourier features of the z-scored study features with
    seeded weights (the oracle has them as literals)."""
    out = _rff_data(spark, sf)
    return out.select("id", *[_r(F.col(f"rff_{j}")).alias(f"rff_{j}") for j in range(RFF_D)])


@query("rbf_svc_oof")
def rbf_svc_oof(spark, sf):
    """Approximate RBF-kernel SVC = linear SVC on the Fourier
    features, out-of-fold labels."""
    d = ev.stratified_folds(_rff_data(spark, sf), "label", "id", 5)
    d = cut_lineage(md.assemble(d, [f"rff_{j}" for j in range(RFF_D)]))
    return md.oof_predictions(lambda n: LinearSVC(regParam=1.0 / n, maxIter=100), d, "id", proba=False)


# ---- J16: boosting ----------------------------------------------------------------------------------------

@query("gbt_oof")
def gbt_oof(spark, sf):
    """Gradient-boosted trees, out-of-fold probabilities."""
    d = _data(spark, sf)
    return md.oof_predictions(lambda n: GBTClassifier(maxIter=10, maxDepth=3, seed=43), d, "id")


@query("gbt_importance")
def gbt_importance(spark, sf):
    """Six stages - trees, depth, leaf size, features per split, sample
    share, then learning rate paired with trees - each by accuracy over
    shuffle splits; importances of the final model."""
    d = _data(spark, sf, with_folds=False)

    def boosted(n, **p):
        return GBTClassifier(seed=43, **({"maxIter": 5, "maxDepth": 3, "stepSize": 0.1} | p))
    stages = [md.grid_of(maxIter=[5, 10]), md.grid_of(maxDepth=[2, 3]), md.grid_of(minInstancesPerNode=[1, 20]),
              md.grid_of(featureSubsetStrategy=["all", "sqrt"]), md.grid_of(subsamplingRate=[0.8, 1.0]),
              [{"stepSize": 0.1}, {"stepSize": 0.05, "maxIter": 20}]]
    best, _ = md.staged_search(boosted, stages, d, n_splits=2)
    return spark.createDataFrame(md.importances(boosted(0, **best).fit(d), FEATS), "variable string, importance double")


# ---- J24 / J25: clustering ----------------------------------------------------------------------------------

KM_COLS = ["acctbal", "n_orders", "avg_price", "max_price", "share_f", "nation"]


@query("kmeans_label")
def kmeans_label(spark, sf):
    """MLlib k-means, k = 2, six raw columns, label appended."""
    s = study(spark, sf)
    d = cut_lineage(md.assemble(s.withColumns({c: F.col(c).cast("double") for c in KM_COLS}), KM_COLS))
    m = KMeans(k=2, seed=43, featuresCol=md.FEATURES).fit(d)
    return m.transform(d).select("id", F.col("prediction").alias("cluster"))


KM_ITERS = 3


def _kmeans_fixed(spark, sf, iters=KM_ITERS):
    s = cut_lineage(study(spark, sf).withColumns({c: F.col(c).cast("double") for c in KM_COLS}))
    lo = s.orderBy("id").select(*KM_COLS).first()
    hi = s.orderBy(F.col("id").desc()).select(*KM_COLS).first()
    return md.kmeans_fixed(s, KM_COLS, [list(lo), list(hi)], iters=iters)


def _kmeans_sql() -> str:
    cols = KM_COLS
    parts = [f"c0 AS (SELECT 0 AS cl, {', '.join(cols)} FROM study WHERE id = (SELECT min(id) FROM study) "
             f"UNION ALL SELECT 1, {', '.join(cols)} FROM study WHERE id = (SELECT max(id) FROM study))"]

    def assign(prev):
        d0 = " + ".join(f"power(s.{c} - a.{c}, 2)" for c in cols)
        d1 = " + ".join(f"power(s.{c} - b.{c}, 2)" for c in cols)
        return (f"SELECT s.*, CASE WHEN ({d1}) < ({d0}) THEN 1 ELSE 0 END AS cl FROM study s "
                f"CROSS JOIN (SELECT * FROM {prev} WHERE cl = 0) a CROSS JOIN (SELECT * FROM {prev} WHERE cl = 1) b")
    for it in range(1, KM_ITERS + 1):
        parts.append(f"a{it} AS ({assign(f'c{it - 1}')})")
        parts.append(f"c{it} AS (SELECT cl, {', '.join(f'avg({c}) AS {c}' for c in cols)} FROM a{it} GROUP BY cl)")
    parts.append(f"fin AS ({assign(f'c{KM_ITERS}')})")
    return ",\n".join(parts)


@query("kmeans_fixed_steps", f"WITH {STUDY_SQL}, {_kmeans_sql()} SELECT id, cl AS cluster FROM fin")
def kmeans_fixed_steps(spark, sf):
    """J24, deterministic: three Lloyd iterations from the rows with the
    smallest and largest id as centres; they have not settled by then (see
    kmeans_settled)."""
    return _kmeans_fixed(spark, sf).select("id", F.col("cluster").cast("int").alias("cluster"))


@query("cluster_profile", f"""WITH {STUDY_SQL}, {_kmeans_sql()}
SELECT cl AS cluster, count(*) AS n, {", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in KM_COLS)},
       round(avg(label), 6) AS label_share FROM fin GROUP BY cl""")
def cluster_profile(spark, sf):
    """Size, column means and label share per cluster after three Lloyd
    iterations only (cluster_profile_settled has the settled clusters)."""
    return _profile(_kmeans_fixed(spark, sf))


def _profile(k):
    return k.groupBy(F.col("cluster").cast("int").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), *[_r(F.avg(c)).alias(f"mean_{c}") for c in KM_COLS],
        _r(F.avg("label")).alias("label_share"))


def _settled_sql() -> str:
    """Lloyd's steps in a recursive query: centres a and b, those before (p, q), and whether a row changed."""
    cols = KM_COLS
    row = lambda where, key: f"SELECT {', '.join(f'{c} AS {key}_{c}' for c in cols)} FROM pts WHERE id = (SELECT {where}(id) FROM pts)"

    def nearer(a, b):
        d = [" + ".join(f"power({c} - {k}_{c}, 2)" for c in cols) for k in (a, b)]
        return f"CASE WHEN {d[1]} < {d[0]} THEN 1 WHEN {d[1]} >= {d[0]} THEN 0 END"
    keep = lambda c, k, v: f"coalesce(avg({c}) FILTER (cl = {v}), any_value({k}_{c}))"
    none = ", ".join(f"NULL::DOUBLE AS {k}_{c}" for k in "pq" for c in cols)
    return f"""pts AS MATERIALIZED (SELECT id, label, {", ".join(f"{c}::DOUBLE AS {c}" for c in cols)} FROM study),
km AS (
  SELECT 0 AS it, true AS moved, a.*, b.*, {none} FROM ({row("min", "a")}) a CROSS JOIN ({row("max", "b")}) b
  UNION ALL
  SELECT it + 1, bool_or(cl IS DISTINCT FROM old), {", ".join(keep(c, "a", 0) for c in cols)}, {", ".join(keep(c, "b", 1) for c in cols)},
         {", ".join(f"any_value({k}_{c})" for k in "ab" for c in cols)}
  FROM (SELECT *, {nearer("a", "b")} AS cl, {nearer("p", "q")} AS old FROM km CROSS JOIN pts WHERE moved) GROUP BY it),
fin AS (SELECT pts.*, {nearer("a", "b")} AS cl FROM pts CROSS JOIN (SELECT * FROM km WHERE NOT moved))"""


@query("kmeans_settled", f"WITH RECURSIVE {STUDY_SQL}, {_settled_sql()} SELECT id, cl AS cluster FROM fin")
def kmeans_settled(spark, sf):
    """J24, deterministic: Lloyd iterations from the rows with the smallest
    and largest id as centres, until no row changes its cluster."""
    return _kmeans_fixed(spark, sf, iters=None).select("id", F.col("cluster").cast("int").alias("cluster"))


@query("cluster_profile_settled", f"""WITH RECURSIVE {STUDY_SQL}, {_settled_sql()}
SELECT cl AS cluster, count(*) AS n, {", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in KM_COLS)},
       round(avg(label), 6) AS label_share FROM fin GROUP BY cl""")
def cluster_profile_settled(spark, sf):
    """Size, column means and label share per settled cluster."""
    return _profile(_kmeans_fixed(spark, sf, iters=None))


@query("oof_predictions")
def oof_predictions(spark, sf):
    """Out-of-fold probabilities of several model families in one long
    table (id, fold, label, model, proba) - the per-run score columns of a
    wide results table, kept long so more runs are a union, not new columns."""
    d = _data(spark, sf)
    makers = {"logit_1": lambda n: md.logistic(n, 1.0),
              "rfc_1": lambda n: RandomForestClassifier(seed=43, numTrees=20, maxDepth=4)}
    labels = d.select("id", "label")
    out = None
    for name, make in makers.items():
        p = md.oof_predictions(make, d, "id").select("id", "fold", F.lit(name).alias("model"), "proba")
        out = p if out is None else out.unionByName(p)
    return out.join(labels, "id").select("id", "fold", "label", "model", _r(F.col("proba")).alias("proba"))
