"""Model fitting and search on MLlib (survey J4-J14, J16, J24, J25).

Fits are MLlib estimators on one cached assembled-vector table; Python only
drives the search loops (grids, elimination steps), never touches rows.
Out-of-fold predictions fit one model per fold on the other folds and
union the held-out predictions.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from tabmill.functions.pvalues import chi2_sf

FEATURES = "features"


@dataclass(frozen=True)
class FeatureSet:
    """One modelling run's columns - drop these, one-hot encode those
    (the categorical list), keep the rest.  ``groups`` maps every variable
    to its exact list of model columns (a categorical to its dummies), so
    eliminations never match siblings by substring."""
    name: str
    drop: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    drop_first: bool = False

    def apply(self, df: DataFrame, exclude: Sequence[str] = ()) -> tuple[DataFrame, list[str], dict[str, list[str]]]:
        from tabmill.operators.impute import one_hot_groups
        kept = [c for c in df.columns if c not in set(self.drop)]
        base = df.select(*kept)
        cats = [c for c in self.categorical if c in kept]
        enc, groups = one_hot_groups(base, cats, drop_first=self.drop_first)
        enc = enc.withColumns({d: F.col(d).cast("double") for g in groups.values() for d in g})
        for c in kept:
            if c not in set(cats) and c not in set(exclude):
                groups[c] = [c]
        cols = [c for g in groups.values() for c in g]
        return enc, cols, groups


def assemble(df: DataFrame, cols: Sequence[str], out: str = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def positive_proba(pred: DataFrame, col: str = "probability") -> F.Column:
    return vector_to_array(F.col(col))[1]


def shuffle_splits(df: DataFrame, id_col: str, n_splits: int = 5, train_pct: int = 70,
                   seed: int = 0) -> DataFrame:
    """``n_splits`` random train/test splits as (split, id, is_train);
    each split is a seeded digest of the id, so it is reproducible on any
    partitioning, after a lost executor, and in any engine with MD5."""
    from tabmill.operators.evaluate import hash_bucket
    splits = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split")
    x = df.select(id_col, splits)
    return x.withColumn("is_train", (hash_bucket(F.col(id_col), F.col("split") + seed) < train_pct).cast("int"))


def shuffle_split_score(est: Estimator, data: DataFrame, splits: DataFrame, id_col: str,
                        label: str = "label") -> DataFrame:
    """Accuracy of ``est`` on each split's test part."""
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    rows = []
    for s in [r[0] for r in splits.select("split").distinct().orderBy("split").collect()]:
        part = data.join(splits.where(F.col("split") == s).select(id_col, "is_train"), id_col)
        model = est.fit(part.where("is_train = 1"))
        acc = ev.evaluate(model.transform(part.where("is_train = 0")))
        rows.append((int(s), float(acc)))
    return data.sparkSession.createDataFrame(rows, "split int, accuracy double")


def grid_search(est: Estimator, grid: list, data: DataFrame, fold_col: str = "fold",
                metric: str = "areaUnderROC", label: str = "label", parallelism: int = 4,
                n_folds: int = 5):
    """Cross-validated grid search over the (1-based) fold column;
    returns the fitted CrossValidatorModel (avgMetrics, bestModel)."""
    ev = BinaryClassificationEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=ev, foldCol=fold_col,
                        numFolds=n_folds, parallelism=parallelism, seed=43)
    return cv.fit(data.withColumn(fold_col, (F.col(fold_col) - 1).cast("int")))


def split_search(make_est: Callable[..., Estimator], grid: Sequence[Mapping], data: DataFrame, id_col: str = "id",
                 label: str = "label", n_splits: int = 5, train_pct: int = 70, seed: int = 43) -> list[tuple[dict, float]]:
    """Mean accuracy of every combination over shuffle splits
    (J4), in the order given.  ``make_est(n_train, **params)`` builds the
    estimator for one split; only accuracies reach the driver."""
    from tabmill.session import cut_lineage
    splits = shuffle_splits(data, id_col, n_splits, train_pct, seed)
    held = cut_lineage(data.join(splits, id_col))
    sizes = {r["split"]: r["n"] for r in held.where("is_train = 1").groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    right = F.avg((F.col("prediction") == F.col(label)).cast("double"))
    out = []
    for params in grid:
        scores = []
        for s, n in sorted(sizes.items()):
            part = held.where(F.col("split") == s)
            model = make_est(n, **params).setLabelCol(label).fit(part.where("is_train = 1"))
            scores.append(model.transform(part.where("is_train = 0")).agg(right).first()[0])
        known = [x for x in scores if x is not None]
        out.append((dict(params), float(sum(known) / len(known)) if known else float("nan")))
    return out


def grid_of(**axes: Sequence) -> list[dict]:
    """All combinations of the axes' values."""
    return [dict(zip(axes, values)) for values in itertools.product(*axes.values())]


def staged_search(make_est: Callable[..., Estimator], stages: Sequence[Sequence[Mapping]], data: DataFrame,
                  **search) -> tuple[dict, list[tuple[int, dict, float]]]:
    """Each stage tries its combinations on top of the best so far (ties
    to the earlier one); returns the final parameters and every trial."""
    best: dict = {}
    trials = []
    for k, stage in enumerate(stages, 1):
        found = split_search(make_est, [best | dict(p) for p in stage], data, **search)
        trials += [(k, p, a) for p, a in found]
        best = max(found, key=lambda pa: pa[1])[0]
    return best, trials


def oof_predictions(make_est: Callable[[int], Estimator], data: DataFrame, id_col: str, fold_col: str = "fold",
                    proba: bool = True, parallelism: int = 5) -> DataFrame:
    """Out-of-fold predictions (id, fold, prediction[, proba]).
    ``make_est`` gets the number of training rows of the fold (the penalty
    of a cost C depends on it).  Up to ``parallelism`` folds are fitted at
    the same time: a fit is a long row of short jobs, which leave most cores
    idle on their own."""
    sizes = {r[0]: r[1] for r in data.groupBy(fold_col).count().orderBy(fold_col).collect()}

    def fit(f):
        return make_est(sum(sizes.values()) - sizes[f]).fit(data.where(F.col(fold_col) != f))
    with ThreadPool(max(1, min(parallelism, len(sizes)))) as pool:
        models = pool.map(inheritable_thread_target(data.sparkSession)(fit), list(sizes), chunksize=1)
    outs = []
    for f, model in zip(sizes, models):
        pred = model.transform(data.where(F.col(fold_col) == f))
        cols = [id_col, fold_col, F.col("prediction").cast("int").alias("prediction")]
        if proba:
            cols.append(positive_proba(pred).alias("proba"))
        outs.append(pred.select(*cols))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def logistic(n_train: int | None = None, c: float = 1.0) -> LogisticRegression:
    """L2 logistic regression with cost C (regParam = 1 / (C n))."""
    reg = 1.0 / (c * n_train) if n_train else 0.0
    return LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=100)


def rfe_ranking(data: DataFrame, cols: Sequence[str], label: str = "label",
                make_est: Callable[[], Estimator] | None = None) -> DataFrame:
    """Recursive feature elimination to a full ranking - fit, drop the
    variable with the smallest squared weight, repeat until one is left
    (rank 1 = kept longest)."""
    remaining = list(cols)
    dropped: list[str] = []
    make_est = make_est or (lambda: LogisticRegression(maxIter=100, standardization=False))
    while len(remaining) > 1:
        m = make_est().setFeaturesCol("__f").setLabelCol(label).fit(assemble(data, remaining, "__f"))
        w = m.coefficients.toArray()
        weakest = min(range(len(remaining)), key=lambda i: (w[i] * w[i], remaining[i]))
        dropped.append(remaining.pop(weakest))
    order = remaining + dropped[::-1]
    return data.sparkSession.createDataFrame([(v, i + 1) for i, v in enumerate(order)], "variable string, rank int")


def logit_inference(data: DataFrame, y: str, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Logistic regression without intercept (binomial GLM): per
    coefficient estimate, SE, z, p; model log-likelihood, null
    log-likelihood (label-mean model), pseudo R2, AIC, BIC, LLR p."""
    glm = GeneralizedLinearRegression(family="binomial", link="logit", fitIntercept=False, maxIter=100,
                                      tol=1e-10, featuresCol="__f", labelCol=y)
    m = glm.fit(assemble(data, cols, "__f"))
    s = m.summary
    coef = m.coefficients.toArray().tolist()
    rows = [(c, float(b), float(se), float(b / se) if se else None)
            for c, b, se in zip(cols, coef, s.coefficientStandardErrors)]
    spark = data.sparkSession
    coefs = spark.createDataFrame(rows, "variable string, coef double, std_err double, z double")
    coefs = coefs.withColumn("p_value", chi2_sf(F.col("z") * F.col("z"), F.lit(1.0)))
    k = len(cols)
    ll = -s.deviance / 2.0
    st = data.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("pbar")).first()
    n, pbar = int(st["n"]), float(st["pbar"])
    null_ll = n * (pbar * math.log(pbar) + (1 - pbar) * math.log(1 - pbar)) if 0 < pbar < 1 else 0.0
    fit = spark.createDataFrame([(n, k, ll, null_ll, s.numIterations < 100)],
                                "n long, k int, ll double, null_ll double, converged boolean")
    fit = fit.select("n", "k", "converged", "ll", "null_ll", (1 - F.col("ll") / F.col("null_ll")).alias("pseudo_r2"),
                     (2 * F.col("k") - 2 * F.col("ll")).alias("aic"),
                     (F.col("k") * F.log(F.col("n").cast("double")) - 2 * F.col("ll")).alias("bic"),
                     chi2_sf(2 * (F.col("ll") - F.col("null_ll")), F.greatest(F.col("k") - 1, F.lit(1)))
                     .alias("llr_p_value"))
    return coefs, fit


def forward_select(data: DataFrame, y: str, ranking: Sequence[str], groups: Mapping[str, Sequence[str]],
                   alpha: float = 0.04) -> DataFrame:
    """Add variables in rank order (a categorical with all its dummy
    columns); keep the newest if its p (any dummy) is below ``alpha``,
    otherwise reject it for good.  ``data`` is the training part.  Each step
    records its model: rows, columns, log-likelihood, pseudo R2, AIC, BIC and
    whether the fit converged."""
    kept: list[str] = []
    rows = []
    for step, var in enumerate(ranking, 1):
        cols = [c for v in kept + [var] for c in groups.get(v, [v])]
        coefs, fit = logit_inference(data, y, cols)
        record = fit.select("n", "k", "ll", "pseudo_r2", "aic", "bic", "converged").first()
        ps = {r["variable"]: r["p_value"] for r in coefs.collect()}
        best_p = min(ps[c] for c in groups.get(var, [var]))
        ok = best_p < alpha
        if ok:
            kept.append(var)
        rows.append((step, var, float(best_p), int(ok), *record))
    return data.sparkSession.createDataFrame(
        rows, "step int, variable string, p_value double, kept int, n long, k int, ll double, "
        "pseudo_r2 double, aic double, bic double, converged boolean")


def importances(model, cols: Sequence[str]) -> list[tuple[str, float]]:
    return list(zip(cols, model.featureImportances.toArray().tolist()))


def backward_eliminate(data: DataFrame, groups: Mapping[str, Sequence[str]], make_est: Callable[[], Estimator],
                       threshold: float = 0.01, label: str = "label") -> DataFrame:
    """While the weakest variable group has *all* its columns below
    ``threshold`` importance, drop the group and refit; stop otherwise."""
    live = dict(groups)
    rows = []
    step = 0
    while len(live) > 1:
        cols = [c for g in live.values() for c in g]
        m = make_est().setFeaturesCol("__f").setLabelCol(label).fit(assemble(data, cols, "__f"))
        imp = dict(importances(m, cols))
        weakest = min(live, key=lambda v: (max(imp[c] for c in live[v]), v))
        if max(imp[c] for c in live[weakest]) >= threshold:
            break
        step += 1
        rows.append((step, weakest, float(max(imp[c] for c in live[weakest]))))
        del live[weakest]
    return data.sparkSession.createDataFrame(rows, "step int, dropped string, importance double")


def rff_weights(n_in: int, n_out: int, gamma: float, seed: int = 43) -> tuple[list[list[float]], list[float]]:
    """Random Fourier feature weights for the kernel exp(-gamma d^2):
    independent normals of variance 2 gamma and uniform phases, seeded."""
    rng = random.Random(seed)
    w = [[rng.gauss(0.0, math.sqrt(2 * gamma)) for _ in range(n_in)] for _ in range(n_out)]
    return w, [rng.uniform(0.0, 2 * math.pi) for _ in range(n_out)]


def rff(df: DataFrame, cols: Sequence[str], n_out: int = 64, gamma: float = 0.2, prefix: str = "rff_",
        seed: int = 43) -> DataFrame:
    """z_j = sqrt(2/D) cos(w_j . x + b_j) as column expressions; z(x).z(y)
    estimates the kernel with an error of order 1/sqrt(D)."""
    w, b = rff_weights(len(cols), n_out, gamma, seed)
    scale = math.sqrt(2.0 / n_out)
    return df.withColumns({f"{prefix}{j}": scale * F.cos(sum(F.lit(w[j][i]) * F.col(c) for i, c in enumerate(cols))
                                                          + F.lit(b[j])) for j in range(n_out)})


def kmeans_fixed(df: DataFrame, cols: Sequence[str], init: Sequence[Sequence[float]], iters: int | None = None,
                 name: str = "cluster") -> DataFrame:
    """J24 (deterministic variant): Lloyd iterations from given centres, until
    no row's cluster changes, or exactly ``iters`` of them.  Each iteration is
    one aggregate (mean per cluster, rows that changed); the centres (k x d
    numbers) are the fitted model carried between iterations.  Ties go to
    the lower cluster index; a cluster without rows keeps its centre."""
    centres = [list(map(float, c)) for c in init]

    def assign(cs):
        d = [sum(F.pow(F.col(c) - F.lit(cs[j][i]), 2) for i, c in enumerate(cols)) for j in range(len(cs))]
        expr = F.lit(0)
        best = d[0]
        for j in range(1, len(cs)):
            expr = F.when(d[j] < best, F.lit(j)).otherwise(expr)
            best = F.least(best, d[j])
        return expr

    before, seen, done = None, set(), 0
    while iters is None or done < iters:
        moved = F.lit(1) if before is None else (assign(centres) != assign(before)).cast("int")
        rows = df.withColumn(name, assign(centres)).withColumn("__moved", moved).groupBy(name).agg(
            *[F.avg(c).alias(c) for c in cols], F.sum("__moved").alias("__moved")).collect()
        if iters is None and not any(r["__moved"] for r in rows):
            break
        new = {r[name]: [float(r[c]) for c in cols] for r in rows}
        before, centres = centres, [new.get(j, centres[j]) for j in range(len(centres))]
        done += 1
        # the same centres again: rows as near to two centres as rounding tells
        key = tuple(map(tuple, centres))
        if iters is None and key in seen:
            break
        seen.add(key)
    return df.withColumn(name, assign(centres))


__all__ = ["GBTClassifier", "LinearSVC", "RandomForestClassifier", "LogisticRegression", "ParamGridBuilder"]
