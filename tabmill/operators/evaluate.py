"""Evaluation: confusion counts and scores, splits and folds, cut-off sweep,
best cut-offs, majority-vote search, ROC points, leaderboard, winner rule,
outcome report (survey D19-D21, D25, E2, E4, J2, J3, J17-J23).

Scale notes:
* the cut-off sweep never builds rows x cut-offs: each score maps to the
  first grid index at which it stops being positive, a partial aggregate
  counts (model, index) and per-model running sums over the fixed grid
  (1,010 rows per model) give every confusion matrix;
* the vote search reduces rows to their prediction bit pattern first
  (at most 2^m x 2 groups), so subsets are scored on that tiny table;
* ROC points use range-partitioned running sums, not a global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabmill.operators.frame import combinations
from tabmill.operators.ordering import row_index, running_sums


# ---- D19 / D20 ------------------------------------------------------------------------------

def confusion(df: DataFrame, y: str, yhat: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """TN, FP, FN, TP (per ``by`` group) in one aggregate."""
    p = yhat if isinstance(yhat, Column) else F.col(yhat)
    t = F.col(y)
    aggs = [F.count_if((t == 0) & (p == 0)).alias("true_negatives"),
            F.count_if((t == 0) & (p == 1)).alias("false_positives"),
            F.count_if((t == 1) & (p == 0)).alias("false_negatives"),
            F.count_if((t == 1) & (p == 1)).alias("true_positives")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def add_scores(conf: DataFrame) -> DataFrame:
    """Recall, precision, F1, total correct / wrong, accuracy.
    0/0 gives NULL (pandas NaN)."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in
                      ("true_negatives", "false_positives", "false_negatives", "true_positives"))
    out = conf.withColumns({"recall": F.try_divide(tp, tp + fn), "precision": F.try_divide(tp, tp + fp)})
    out = out.withColumn("f1_score", F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                  F.col("precision") + F.col("recall")))
    return out.withColumns({
        "total_correct": F.col("true_negatives") + F.col("true_positives"),
        "total_wrong": F.col("false_positives") + F.col("false_negatives"),
        "accuracy": F.try_divide((tn + tp), (tn + tp + fp + fn))})


# ---- J2 / J3 ----------------------------------------------------------------------------------

def hash_bucket(key: Column, seed: Column, buckets: int = 100) -> Column:
    """0 .. buckets - 1 from the first 32 bits of MD5(key:seed)."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), seed.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets))


def hash_split(df: DataFrame, id_col: str, train_pct: int = 67, seed: int = 43,
               method: str = "hash") -> DataFrame:
    """Deterministic train/test split by a hash of the id (no shuffle,
    reproducible after a lost executor).  ``method='mod'`` uses id % 100."""
    if method == "mod":
        bucket = F.pmod(F.col(id_col), F.lit(100))
    else:
        bucket = hash_bucket(F.col(id_col), F.lit(seed))
    return df.withColumn("is_train", (bucket < train_pct).cast("int"))


def stratified_folds(df: DataFrame, y: str, id_col: str, k: int = 5) -> DataFrame:
    """fold = ntile(k) within each class in id order (contiguous folds
    per class, as an unshuffled stratified k-fold).  The class-wise
    position comes from distributed running sums, so a class holding most
    rows is still numbered by many tasks."""
    pos = row_index(df, [id_col], "__r", group=[y])
    # a class may hold most rows: its total is a literal (one number per class), not a join on the class
    totals = df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()
    n = F.lit(None).cast("long")
    for t in totals:
        n = F.when(F.col(y).eqNullSafe(F.lit(t[y])), F.lit(t["n"])).otherwise(n)
    j = pos.withColumn("__n", n)
    q = (F.col("__n") / k).cast("long")
    rem = F.col("__n") % k
    big = rem * (q + 1)
    fold = F.when(F.col("__r") < big, (F.col("__r") / (q + 1)).cast("long")).otherwise(
        rem + ((F.col("__r") - big) / F.greatest(q, F.lit(1))).cast("long"))
    return j.withColumn("fold", (fold + 1).cast("int")).drop("__r", "__n")


# ---- J17 / J18: cut-off sweep -------------------------------------------------------------------

def cut_index(p: Column, scale: int = 1000) -> Column:
    """First grid index i (cut-off i/scale) at which ``p > cut-off`` fails:
    p > i/scale  <=>  i < ceil(round(p * scale, 9))."""
    return F.ceil(F.round(p * scale, 9)).cast("long")


def cutoff_sweep(scores: DataFrame, model: str = "model", p: str = "p", y: str = "label",
                 steps: int = 1010, scale: int = 1000) -> DataFrame:
    """Confusion counts and scores of ``p > c`` for every model and
    every cut-off c = i/scale, i = 0..steps-1."""
    b = F.least(F.greatest(cut_index(F.col(p), scale), F.lit(0)), F.lit(steps))
    hist = scores.groupBy(F.col(model).alias("model"), b.alias("i")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    grid = hist.select("model").distinct().withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"),
                                                                                F.lit(steps).cast("long"))))
    g = grid.join(hist, ["model", "i"], "left").fillna(0, ["pos", "neg"])
    w = Window.partitionBy("model").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wt = Window.partitionBy("model")
    g = g.withColumns({"cum_pos": F.sum("pos").over(w), "cum_neg": F.sum("neg").over(w),
                       "tot_pos": F.sum("pos").over(wt), "tot_neg": F.sum("neg").over(wt)})
    g = g.where(F.col("i") < steps)
    conf = g.select("model", F.col("i").alias("cut_idx"), F.round(F.col("i") / scale, 3).alias("cut_off"),
                    F.col("cum_neg").alias("true_negatives"),
                    (F.col("tot_neg") - F.col("cum_neg")).alias("false_positives"),
                    F.col("cum_pos").alias("false_negatives"),
                    (F.col("tot_pos") - F.col("cum_pos")).alias("true_positives"))
    return add_scores(conf)


def best_rows(df: DataFrame, by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """The top row per group by total correct, then F1 (NULL
    last), then the ``tie`` columns ascending."""
    w = Window.partitionBy(*by).orderBy(F.col("total_correct").desc(), F.col("f1_score").desc_nulls_last(),
                                        *[F.col(t).asc() for t in tie])
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def best_cutoffs(sweep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Best cut-off per model, then best model per family (the part of
    the name before '_')."""
    per_model = best_rows(sweep, ["model"], ["cut_off"])
    per_model = per_model.withColumn("model_type", F.split_part(F.col("model"), F.lit("_"), F.lit(1)))
    per_family = best_rows(per_model, ["model_type"], ["model"])
    return per_model, per_family


# ---- J19: majority-vote search --------------------------------------------------------------------

def vote_search(scores: DataFrame, chosen: DataFrame, sizes: Sequence[int] = (1, 3, 5),
                id_col: str = "id", scale: int = 1000, max_models: int = 20) -> DataFrame:
    """Majority vote of every subset of the chosen (model, cut_idx)
    predictors of the given sizes, scored.

    Each row becomes one bit pattern of its m predictions (one aggregate per
    id), then rows are counted per (pattern, label) - at most 2^m x 2
    groups - and every subset is scored on that table.
    """
    members = combinations(chosen.select("model"), "model", sizes, max_models)
    idx = members.select("model", "idx").distinct()
    ch = chosen.select("model", "cut_idx").join(idx, "model")
    # the chosen table has one row per model: a bounded broadcast
    pred = scores.join(F.broadcast(ch), "model").select(
        id_col, "label", (cut_index(F.col("p"), scale) > F.col("cut_idx")).cast("long").alias("pred"), "idx")
    bits = pred.groupBy(id_col, "label").agg(F.sum(F.col("pred") * F.pow(F.lit(2), F.col("idx")).cast("long"))
                                             .alias("bits"))
    patt = bits.groupBy("bits", "label").agg(F.count(F.lit(1)).alias("n"))
    masks = members.groupBy("mask", "size").agg(
        F.array_join(F.array_sort(F.collect_list("model")), ", ").alias("models"))
    # both sides are tiny (<= 2^m x 2 patterns, <= 2^m masks): attach masks
    # to patterns by exploding the mask list, not by a join
    mask_list = masks.select(F.collect_list(F.struct("mask", "size", "models"))).scalar()
    votes = patt.select("bits", "label", "n", F.explode(mask_list).alias("m")).select(
        "bits", "label", "n", "m.mask", "m.size", "m.models")
    agree = F.bit_count(F.col("bits").bitwiseAND(F.col("mask")))
    votes = votes.withColumn("vote", (agree * 2 > F.col("size")).cast("int"))
    conf = votes.groupBy("mask", "size", "models").agg(
        F.sum(F.when((F.col("label") == 0) & (F.col("vote") == 0), F.col("n")).otherwise(0)).alias("true_negatives"),
        F.sum(F.when((F.col("label") == 0) & (F.col("vote") == 1), F.col("n")).otherwise(0)).alias("false_positives"),
        F.sum(F.when((F.col("label") == 1) & (F.col("vote") == 0), F.col("n")).otherwise(0)).alias("false_negatives"),
        F.sum(F.when((F.col("label") == 1) & (F.col("vote") == 1), F.col("n")).otherwise(0)).alias("true_positives"))
    return add_scores(conf)


# ---- J20-J22 ----------------------------------------------------------------------------------

def pick_winner(runs: DataFrame, by: Sequence[str] = ("model_type",), size: str = "n_vars",
                name: str = "model") -> DataFrame:
    """Per group the run with the highest F1; ties -> fewest variables,
    then name (a fixed rule instead of a random pick)."""
    w = Window.partitionBy(*by).orderBy(F.col("f1_score").desc_nulls_last(), F.col(size).asc(), F.col(name).asc())
    return runs.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def outcome_report(winner: DataFrame) -> DataFrame:
    """How many rows the winner has right and wrong, the smaller of the
    two classes' shares of each, and its accuracy (one row per outcome)."""
    right, wrong = ("true_negatives", "true_positives"), ("false_positives", "false_negatives")
    total = {k: F.col(a) + F.col(b) for k, (a, b) in (("right", right), ("wrong", wrong))}
    rows = F.array(*[F.struct(F.lit(k).alias("outcome"), total[k].alias("total"), F.least(*pair).alias("minimum"))
                     for k, pair in (("right", right), ("wrong", wrong))])
    share = F.try_divide(total["right"].cast("double"), (total["right"] + total["wrong"]).cast("double"))
    return winner.select(F.inline(rows), share.alias("accuracy"))


# ---- J23 / E4: ROC -------------------------------------------------------------------------------

def roc_points(scores: DataFrame, model: str = "model", p: str = "p", y: str = "label") -> DataFrame:
    """For every model and distinct score t (descending), the true and
    false positive rates of the rule ``p >= t``."""
    per = scores.groupBy(F.col(model).alias("model"), F.col(p).alias("threshold")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    cum = running_sums(per, [("threshold", False)], {"tps": F.col("pos"), "fps": F.col("neg")}, group=["model"])
    tot = per.groupBy("model").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    out = cum.join(tot, "model")
    return out.select("model", "threshold", "tps", "fps",
                      F.try_divide(F.col("tps").cast("double"), F.col("P").cast("double")).alias("tpr"),
                      F.try_divide(F.col("fps").cast("double"), F.col("N").cast("double")).alias("fpr"))
