"""Queries on batched fits: the search over seven feature sets, and the
evaluation (sweep, votes, ROC, leaderboard) of their out-of-fold scores
(J1, J3, J5, J6, J10, J17-J23 on real fits), and the search over kernel
classifiers (J14).

The fits are iterative, so SQL can't express them; tests hold the fits
against a plain solver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabmill.operators import batch_fit as bf
from tabmill.operators import evaluate as ev
from tabmill.operators import kernel as kn
from tabmill.operators.dist import zscore
from tabmill.operators.impute import one_hot_groups
from tabmill.plans.inputs import study
from tabmill.plans.registry import query
from tabmill.session import cut_lineage

NUMBERS = ("acctbal", "n_orders", "avg_price", "max_price", "share_f")
CATEGORICAL = ("region", "seg", "big")
#: The seven feature sets, by variables.
SETS = {
    "logit_1": NUMBERS,
    "logit_2": (*NUMBERS, "region"),
    "logit_3": (*NUMBERS, "seg"),
    "logit_4": (*NUMBERS, *CATEGORICAL),
    "logit_5": ("avg_price", "max_price", "big"),
    "logit_6": ("acctbal", "n_orders", "share_f", "seg"),
    "logit_7": CATEGORICAL,
}
COSTS = (0.01, 0.1, 1.0, 10.0)
SPLITS, FOLDS, SEED, TRAIN = 5, 5, 43, 70


def _encoded(df: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """z-scored numbers and 0/1 columns of the categoricals (the smallest level dropped), with each variable's columns."""
    enc, groups = one_hot_groups(zscore(df, list(NUMBERS)), CATEGORICAL, drop_first=True)
    return enc, {**{c: [c] for c in NUMBERS}, **groups}


def _columns(groups: dict[str, list[str]], variables) -> tuple[str, ...]:
    return tuple(c for v in variables for c in groups[v])


def _search(enc: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """model (set and cost), accuracy: the mean over the splits; every fit of the search runs in the same passes."""
    every = _columns(groups, groups)
    bits = sum((F.when(ev.hash_bucket(F.col("id"), F.lit(s + SEED)) < TRAIN, F.lit(1 << s)).otherwise(F.lit(0)) for s in range(SPLITS)), F.lit(0))
    rows = bf.table(enc, "id", "label", every, bits)
    fits = [bf.Fit(f"{name}:{cost}", _columns(groups, of), cost, s) for name, of in SETS.items() for cost in COSTS for s in range(SPLITS)]
    return bf.accuracy(bf.out_of_part(rows, every, bf.fit_all(rows, every, fits)))


def _out_of_fold(spark, sf) -> tuple[DataFrame, dict[str, float]]:
    """(id, label, model, p) of the seven sets, each at its best cost (ties to the smaller), and these costs."""
    enc, groups = _encoded(study(spark, sf))
    enc = cut_lineage(enc)
    best: dict[str, tuple[float, float]] = {}
    for r in _search(enc, groups).collect():
        name, cost = r["model"].split(":")
        best[name] = min(best.get(name, (0.0, 0.0)), (-r["accuracy"], float(cost)))
    folded = ev.stratified_folds(enc, "label", "id", FOLDS)
    every = _columns(groups, groups)
    rows = bf.table(folded, "id", "label", every, bf.fold_bits("fold", FOLDS))
    fits = [bf.Fit(name, _columns(groups, of), best[name][1], f) for name, of in SETS.items() for f in range(1, FOLDS + 1)]
    scores = bf.out_of_part(rows, every, bf.fit_all(rows, every, fits)).select("id", "label", "model", "p")
    return cut_lineage(scores), {name: cost for name, (_, cost) in best.items()}


@query("logit_grid_sets")
def logit_grid_sets(spark, sf):
    """Accuracy over five shuffle splits of every feature set and cost (140 fits in one search)."""
    enc, groups = _encoded(study(spark, sf))
    found = _search(cut_lineage(enc), groups)
    part = F.split("model", ":")
    return found.select(part[0].alias("model"), part[1].cast("double").alias("cost"), F.round("accuracy", 6).alias("accuracy"))


@query("fitted_leaderboard")
def fitted_leaderboard(spark, sf):
    """The fitted sets at their best cut-offs, with parameters and the variables used and not used."""
    scores, costs = _out_of_fold(spark, sf)
    per_model, _ = ev.best_cutoffs(ev.cutoff_sweep(scores))
    known = spark.createDataFrame([(m, {"cost": costs[m]}, list(of), [v for v in (*NUMBERS, *CATEGORICAL) if v not in of], len(of)) for m, of in SETS.items()],
                                  "model string, params map<string, double>, variables array<string>, not_used array<string>, n_vars int")
    lb = per_model.join(F.broadcast(known), "model")  # one row per feature set
    return lb.select("model_type", "model", "cut_off", "f1_score", "recall", "precision", "total_correct", "total_wrong", "n_vars",
                     F.to_json("params").alias("params"), F.array_join("variables", ", ").alias("variables_used"),
                     F.array_join("not_used", ", ").alias("variables_not_used"))


@query("fitted_votes")
def fitted_votes(spark, sf):
    """Majority votes of all 1/3/5-subsets of the seven fitted sets, each at its best cut-off."""
    scores, _ = _out_of_fold(spark, sf)
    per_model, _ = ev.best_cutoffs(ev.cutoff_sweep(scores))
    return ev.vote_search(scores, cut_lineage(per_model.select("model", "cut_idx")), (1, 3, 5))


@query("fitted_roc")
def fitted_roc(spark, sf):
    """ROC points of the out-of-fold scores."""
    return ev.roc_points(_out_of_fold(spark, sf)[0])


@query("forward_by_score")
def forward_by_score(spark, sf):
    """Forward selection by score tests; a step is one fit, whatever the number of candidates."""
    enc, groups = _encoded(study(spark, sf))
    every = _columns(groups, groups)
    path = bf.forward_by_score(bf.table(enc, "id", "label", every, F.lit(1)), every, groups, alpha=0.5)
    return spark.createDataFrame([(k, *p) for k, p in enumerate(path, 1)], "step int, variable string, statistic double, p_value double")


# ---- J14: kernel support vectors ------------------------------------------------------------------

KERNELS, GAMMAS, SVC_COSTS, LANDMARKS = ("rbf", "sigmoid"), (0.05, 0.2), (0.1, 1.0, 10.0), 64


def _svc_bits() -> F.Column:
    """Training bits of the shuffle splits."""
    return sum((F.when(ev.hash_bucket(F.col("id"), F.lit(s + SEED)) < TRAIN, F.lit(1 << s)).otherwise(F.lit(0)) for s in range(SPLITS)), F.lit(0))


def _svc_search(enc: DataFrame, every: tuple[str, ...]) -> DataFrame:
    """model (kernel:gamma:cost), accuracy: the mean over the splits; all fits run in the same passes."""
    rows = bf.table(enc, "id", "label", every, _svc_bits())
    fits = [kn.Svc(f"{k}:{g}:{c}", k, g, c, s) for k in KERNELS for g in GAMMAS for c in SVC_COSTS for s in range(SPLITS)]
    return kn.accuracy(kn.out_of_part(rows, kn.fit_all(rows, fits, kn.landmarks(rows, LANDMARKS))))


@query("kernel_svc_search")
def kernel_svc_search(spark, sf):
    """Accuracy over five shuffle splits of every kernel, gamma and cost."""
    enc, groups = _encoded(study(spark, sf))
    part = F.split("model", ":")
    return _svc_search(cut_lineage(enc), _columns(groups, groups)).select(
        part[0].alias("kernel"), part[1].cast("double").alias("gamma"), part[2].cast("double").alias("cost"), F.round("accuracy", 6).alias("accuracy"))


@query("kernel_svc_oof")
def kernel_svc_oof(spark, sf):
    """Out-of-fold decision values and labels of both kernels at one gamma and cost (the search is ``kernel_svc_search``)."""
    enc, groups = _encoded(study(spark, sf))
    folded, every = ev.stratified_folds(enc, "label", "id", FOLDS), _columns(groups, groups)
    rows = bf.table(folded, "id", "label", every, bf.fold_bits("fold", FOLDS))
    fits = [kn.Svc(k, k, GAMMAS[-1], 1.0, f) for k in KERNELS for f in range(1, FOLDS + 1)]
    scores = kn.out_of_part(rows, kn.fit_all(rows, fits, kn.landmarks(rows, LANDMARKS)))
    return scores.select("id", "label", "model", F.round("decision", 4).alias("decision"), (F.col("decision") > 0).cast("int").alias("predicted"))
