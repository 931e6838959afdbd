"""Evaluation queries.

Input: the five deterministic model scores per order (``inputs.scores``).
The oracles brute-force what the operators compute incrementally: the
sweep cross-joins rows with all 1,010 cut-offs, the vote search votes per
row and subset.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tabmill.functions import scalars
from tabmill.operators import evaluate as ev
from tabmill.operators.frame import melt, with_position
from tabmill.plans.inputs import SCORES_SQL, STUDY_SQL, scores, study
from tabmill.plans.registry import query
from tabmill.sources import snapshot

R = 6
SCORE_COLS = ["recall", "precision", "f1_score", "accuracy"]
CONF = ["true_negatives", "false_positives", "false_negatives", "true_positives"]

# fixed values: spelled-out family names of the studied project
FAMILY_NAMES = {"logit": "Logistic Regression", "rfc": "Random Forest Classifier", "knn": "K-Nearest Neighbors",
                "svc": "Support Vector Machine Classifier", "gbm": "Gradient Boosting Classifier"}
# the variables each stand-in model's formula reads (the model specification)
MODEL_VARS = {"logit_1": ["o_orderkey"], "logit_2": ["o_orderkey", "o_orderpriority"], "rfc_1": ["o_totalprice"],
              "knn_1": ["o_custkey", "o_orderkey", "o_orderpriority"],
              "gbm_1": ["o_custkey", "o_orderkey", "o_orderpriority"]}


def _r(c, d=R):
    return F.round(c, d)


def _rs(df):
    return df.withColumns({c: _r(F.col(c)) for c in SCORE_COLS if c in df.columns})


def _scores_sql(src: str) -> str:
    return f"""SELECT *, round(CASE WHEN true_positives + false_negatives = 0 THEN NULL
    ELSE true_positives / (true_positives + false_negatives) END, 6) AS recall,
  round(CASE WHEN true_positives + false_positives = 0 THEN NULL
    ELSE true_positives / (true_positives + false_positives) END, 6) AS precision,
  round(CASE WHEN true_positives = 0 THEN NULL
    ELSE 2.0 * true_positives / (2 * true_positives + false_positives + false_negatives) END, 6) AS f1_score,
  true_negatives + true_positives AS total_correct, false_positives + false_negatives AS total_wrong,
  round((true_negatives + true_positives) / (true_negatives + true_positives + false_positives + false_negatives), 6)
    AS accuracy
FROM {src}"""


# ---- J2 / J3 ----------------------------------------------------------------------------------

@query("hash_split", f"WITH {STUDY_SQL} SELECT id, CAST(id % 100 < 67 AS INTEGER) AS is_train FROM study")
def hash_split(spark, sf):
    return ev.hash_split(study(spark, sf), "id", 67, method="mod").select("id", "is_train")


@query("stratified_folds", f"""WITH {STUDY_SQL}
SELECT id, label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY id) AS INTEGER) AS fold FROM study""")
def stratified_folds(spark, sf):
    return ev.stratified_folds(study(spark, sf).select("id", "label"), "label", "id", 5)


# ---- D19 / D20 ----------------------------------------------------------------------------------

_CONF05_SQL = f"""WITH {SCORES_SQL},
c AS (SELECT model, count_if(label = 0 AND NOT p > 0.5) AS true_negatives, count_if(label = 0 AND p > 0.5) AS false_positives,
             count_if(label = 1 AND NOT p > 0.5) AS false_negatives, count_if(label = 1 AND p > 0.5) AS true_positives
      FROM scores GROUP BY model)"""


@query("confusion_counts", _CONF05_SQL + " SELECT * FROM c")
def confusion_counts(spark, sf):
    s = scores(spark, sf)
    return ev.confusion(s, "label", (F.col("p") > 0.5).cast("int"), ["model"])


@query("classification_scores", _CONF05_SQL + " " + _scores_sql("c"))
def classification_scores(spark, sf):
    s = scores(spark, sf)
    return _rs(ev.add_scores(ev.confusion(s, "label", (F.col("p") > 0.5).cast("int"), ["model"])))


# ---- J17 / J18 ---------------------------------------------------------------------------------------

_SWEEP_CTE = f"""{SCORES_SQL},
sw0 AS (SELECT s.model, g.i AS cut_idx, round(g.i / 1000.0::DOUBLE, 3) AS cut_off,
  count_if(label = 0 AND NOT round(p * 1000, 9) > g.i) AS true_negatives,
  count_if(label = 0 AND round(p * 1000, 9) > g.i) AS false_positives,
  count_if(label = 1 AND NOT round(p * 1000, 9) > g.i) AS false_negatives,
  count_if(label = 1 AND round(p * 1000, 9) > g.i) AS true_positives
  FROM scores s CROSS JOIN range(0, 1010) g(i) GROUP BY s.model, g.i),
sw AS ({_scores_sql('sw0')}),
bm AS (SELECT *, split_part(model, '_', 1) AS model_type FROM sw
       QUALIFY row_number() OVER (PARTITION BY model ORDER BY total_correct DESC, f1_score DESC NULLS LAST, cut_off) = 1),
bf AS (SELECT * FROM bm
       QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY total_correct DESC, f1_score DESC NULLS LAST, model) = 1)"""


def _sweep(spark, sf):
    return ev.cutoff_sweep(scores(spark, sf))


@query("cutoff_sweep", f"WITH {_SWEEP_CTE} SELECT * FROM sw")
def cutoff_sweep(spark, sf):
    """5 models x 1,010 cut-offs, O(rows) work."""
    return _rs(_sweep(spark, sf))


@query("best_cutoff", f"WITH {_SWEEP_CTE} SELECT * FROM bf")
def best_cutoff(spark, sf):
    """Best cut-off per model, then the best model per family."""
    _, fam = ev.best_cutoffs(_sweep(spark, sf))
    return _rs(fam)


# ---- J19 -------------------------------------------------------------------------------------------

_VOTE_CTE = _SWEEP_CTE + """,
mi AS (SELECT model, cut_idx, CAST(row_number() OVER (ORDER BY model) - 1 AS INTEGER) AS idx FROM bm),
pr AS (SELECT s.id, s.label, mi.idx, CAST(round(s.p * 1000, 9) > mi.cut_idx AS INTEGER) AS pred
       FROM scores s JOIN mi USING (model)),
mk AS (SELECT mask FROM range(1, 1024) t(mask)
       WHERE mask < (SELECT 1 << count(*) FROM mi) AND bit_count(mask) IN (1, 3, 5)),
mm AS (SELECT mk.mask, mi.model, mi.idx FROM mk JOIN mi ON (mk.mask >> mi.idx) & 1 = 1),
vt AS (SELECT mm.mask, pr.id, pr.label, sum(pr.pred) AS yes, count(*) AS k FROM pr JOIN mm ON pr.idx = mm.idx
       GROUP BY mm.mask, pr.id, pr.label),
cf AS (SELECT v.mask, CAST(bit_count(v.mask) AS INTEGER) AS size, nm.models,
         count_if(label = 0 AND 2 * yes <= k) AS true_negatives, count_if(label = 0 AND 2 * yes > k) AS false_positives,
         count_if(label = 1 AND 2 * yes <= k) AS false_negatives, count_if(label = 1 AND 2 * yes > k) AS true_positives
       FROM vt v JOIN (SELECT mask, string_agg(model, ', ' ORDER BY model) AS models FROM mm GROUP BY mask) nm
         ON nm.mask = v.mask GROUP BY v.mask, nm.models),
vs AS (""" + _scores_sql("cf") + ")"


def _votes(spark, sf):
    s = scores(spark, sf)
    per_model, _ = ev.best_cutoffs(ev.cutoff_sweep(s))
    return ev.vote_search(s, per_model.select("model", "cut_idx"), (1, 3, 5))


@query("vote_ensemble", f"WITH {_VOTE_CTE} SELECT * FROM vs")
def vote_ensemble(spark, sf):
    """Majority votes of all 1/3/5-subsets of the five models, each at
    its best cut-off."""
    v = _votes(spark, sf)
    return _rs(v.withColumn("size", F.col("size").cast("int")))


_WIN_VOTE = " QUALIFY row_number() OVER (ORDER BY total_correct DESC, f1_score DESC NULLS LAST, size, mask) = 1"


@query("outcome_report", f"""WITH {_VOTE_CTE}, w AS (SELECT * FROM vs {_WIN_VOTE})
SELECT 'right' AS outcome, true_negatives + true_positives AS total,
       least(true_negatives, true_positives) AS minimum, accuracy FROM w
UNION ALL SELECT 'wrong', false_positives + false_negatives, least(false_positives, false_negatives), accuracy FROM w""")
def outcome_report(spark, sf):
    """Report of the winning vote subset."""
    v = _rs(_votes(spark, sf))
    w = v.orderBy(F.col("total_correct").desc(), F.col("f1_score").desc_nulls_last(), "size", "mask").limit(1)
    return ev.outcome_report(w).withColumn("accuracy", _r(F.col("accuracy")))


# ---- J20 / J21 / F2 / G4 / S3 / A7 ----------------------------------------------------------------------

_VARS_SQL = "CASE model " + " ".join(
    f"WHEN '{m}' THEN '{', '.join(v)}'" for m, v in MODEL_VARS.items()) + " END"
_NVARS_SQL = "CASE model " + " ".join(f"WHEN '{m}' THEN {len(v)}" for m, v in MODEL_VARS.items()) + " END"

_LB_CTE = _SWEEP_CTE + f""",
lb AS (SELECT model_type, CAST(split_part(model, '_', 2) AS INTEGER) AS run, model, cut_off, f1_score, recall, precision,
              total_correct, total_wrong, CAST({_NVARS_SQL} AS INTEGER) AS n_vars, {_VARS_SQL} AS variables_used FROM bm)"""


def _leaderboard(spark, sf):
    per_model, _ = ev.best_cutoffs(_sweep(spark, sf))
    vmap = F.create_map(*[x for m, v in MODEL_VARS.items() for x in (F.lit(m), F.array(*[F.lit(c) for c in v]))])
    lb = per_model.select("model_type", scalars.part("model", "_", -1).cast("int").alias("run"), "model", "cut_off",
                          "f1_score", "recall", "precision", "total_correct", "total_wrong",
                          *CONF, vmap[F.col("model")].alias("variables"))
    return _rs(lb).withColumn("n_vars", F.size("variables").cast("int"))


@query("leaderboard", f"WITH {_LB_CTE} SELECT * FROM lb")
def leaderboard(spark, sf):
    """One row per model run with its scores and the variables used."""
    lb = _leaderboard(spark, sf)
    return lb.select("model_type", "run", "model", "cut_off", "f1_score", "recall", "precision", "total_correct",
                     "total_wrong", "n_vars", F.array_join("variables", ", ").alias("variables_used"))


@query("pick_winner", f"""WITH {_LB_CTE} SELECT model_type, model, f1_score, n_vars FROM lb
QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY f1_score DESC NULLS LAST, n_vars, model) = 1""")
def pick_winner(spark, sf):
    """Max F1 per family, ties -> fewest variables, then name."""
    return ev.pick_winner(_leaderboard(spark, sf)).select("model_type", "model", "f1_score", "n_vars")


@query("leaderboard_sort", f"""WITH {_LB_CTE}
SELECT CAST(row_number() OVER (ORDER BY total_correct DESC, f1_score DESC NULLS LAST, model) - 1 AS BIGINT) AS position,
       model, total_correct, f1_score FROM lb""")
def leaderboard_sort(spark, sf):
    """two-key sort (total correct desc, F1 desc, NULL last) with the
    resulting 0-based position."""
    lb = _leaderboard(spark, sf).select("model", "total_correct", "f1_score")
    # f1 NULL sorts last: order on a non-null key with NULL mapped below any score
    lb = lb.withColumn("__f1", F.coalesce(F.col("f1_score"), F.lit(-1.0)))
    out = with_position(lb, [("total_correct", False), ("__f1", False), ("model", True)], "position")
    return out.drop("__f1")


@query("unpivot_counts", f"""WITH {_LB_CTE.replace('lb AS (SELECT model_type', 'lb AS (SELECT true_negatives, false_positives, false_negatives, true_positives, model_type')}
SELECT model, outcome, n FROM (UNPIVOT (SELECT model, true_negatives, false_positives, false_negatives, true_positives FROM lb)
  ON true_negatives, false_positives, false_negatives, true_positives INTO NAME outcome VALUE n)""")
def unpivot_counts(spark, sf):
    """Confusion counts per run, wide -> long."""
    return melt(_leaderboard(spark, sf), ["model"], CONF, "outcome", "n")


def _display_sql(col: str) -> str:
    fam = f"split_part({col}, '_', 1)"
    return ("(CASE " + " ".join(f"WHEN {fam} = '{k}' THEN '{v}'" for k, v in FAMILY_NAMES.items())
            + f" ELSE {fam} END || ' ' || split_part({col}, '_', 2))")


def display(col) -> F.Column:
    return scalars.display_name(col, replace=FAMILY_NAMES)


@query("display_names", f"WITH {_LB_CTE} SELECT model, {_display_sql('model')} AS display_name FROM lb")
def display_names(spark, sf):
    """S3: spelled-out family, '_' -> ' ', title case."""
    return _leaderboard(spark, sf).select("model", display(F.col("model")).alias("display_name"))


# fixed values: the export's column headings
_EXPORT = {"models": "Model(s)", "f1_score": "F1 Score", "recall": "Recall", "precision": "Precision",
           "total_correct": "Total Correct", "total_wrong": "Total Incorrect"}


@query("leaderboard_export", f"""WITH {_VOTE_CTE}
SELECT models AS "Model(s)", f1_score AS "F1 Score", recall AS "Recall", precision AS "Precision",
       total_correct AS "Total Correct", total_wrong AS "Total Incorrect" FROM vs""")
def leaderboard_export(spark, sf):
    """The vote table as CSV with renamed columns; read back to check."""
    v = _rs(_votes(spark, sf))
    path = snapshot.scratch_path(spark, "final-models")
    snapshot.to_csv(v, path, _EXPORT)
    schema = StructType([StructField("Model(s)", StringType()), StructField("F1 Score", DoubleType()),
                         StructField("Recall", DoubleType()), StructField("Precision", DoubleType()),
                         StructField("Total Correct", LongType()), StructField("Total Incorrect", LongType())])
    return spark.read.option("header", True).schema(schema).csv(path)


# ---- J23 / E4 ---------------------------------------------------------------------------------------------

@query("roc_curve", f"""WITH {SCORES_SQL},
per AS (SELECT model, p AS threshold, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM scores GROUP BY ALL),
c AS (SELECT model, threshold,
        sum(pos) OVER (PARTITION BY model ORDER BY threshold DESC) AS tps,
        sum(neg) OVER (PARTITION BY model ORDER BY threshold DESC) AS fps,
        sum(pos) OVER (PARTITION BY model) AS tp_all, sum(neg) OVER (PARTITION BY model) AS fp_all FROM per)
SELECT model, round(threshold, 6) AS threshold, CAST(tps AS BIGINT) AS tps, CAST(fps AS BIGINT) AS fps,
       round(tps / tp_all::DOUBLE, 6) AS tpr, round(fps / fp_all::DOUBLE, 6) AS fpr FROM c""")
def roc_curve(spark, sf):
    """Per model, TPR/FPR of ``p >= t`` at each distinct score."""
    r = ev.roc_points(scores(spark, sf))
    return r.select("model", _r(F.col("threshold")).alias("threshold"), F.col("tps").cast("long"),
                    F.col("fps").cast("long"), _r(F.col("tpr")).alias("tpr"), _r(F.col("fpr")).alias("fpr"))
