"""Nearest-neighbour join, k-NN classifier and imputation queries
(C3, I4-I8, J15).

Oracles brute-force every (query, training) pair in DuckDB.  For z-scored
one-hot categoricals they use the closed form: two different levels a, b
add 1/(p_a(1-p_a)) + 1/(p_b(1-p_b)) to the squared distance (p = the
level's share among training rows; a level absent from training scales
by 1), which is what the Spark side gets from explicit dummy columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabmill.operators import evaluate as ev
from tabmill.operators import impute, knn, profile
from tabmill.operators.dist import zscore
from tabmill.plans.inputs import STUDY_MISSING_SQL, STUDY_SQL, study, study_missing
from tabmill.plans.registry import query
from tabmill.session import cut_lineage

R = 6
CATEGORICAL = ["seg", "nation", "region", "big"]
_MISS_COLS = ["acctbal", "n_orders", "avg_price", "max_price", "share_f", "seg", "nation", "region", "big", "label"]
_MISS_SUM = " + ".join(f"CAST({c} = -9 AS INTEGER)" for c in _MISS_COLS)
_KEPT_SQL = STUDY_MISSING_SQL + f""",
kept AS (SELECT * FROM study_missing WHERE ({_MISS_SUM}) / 10.0 <= 0.10)"""


def _r(c, d=R):
    return F.round(c, d)


def _kept(spark, sf):
    return profile.drop_sparse_rows(study_missing(spark, sf), "id", 0.10)


# ---- C3: the join itself --------------------------------------------------------------------------

JOIN_FEATS = ["acctbal", "n_orders", "share_f"]


@query("knn_join", f"""WITH {_KEPT_SQL},
tr AS (SELECT * FROM kept WHERE avg_price <> -9), q AS (SELECT * FROM kept WHERE avg_price = -9),
st AS (SELECT {", ".join(f"CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in JOIN_FEATS)} FROM tr),
pairs AS (SELECT q.id AS qid, t.id AS tid,
   sqrt({" + ".join(f"power((q.{c} - t.{c}) / s_{c}, 2)" for c in JOIN_FEATS)}) AS dist FROM q CROSS JOIN tr t CROSS JOIN st)
SELECT qid, tid, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), tid) AS rank FROM pairs) WHERE rank <= 5""")
def knn_join(spark, sf):
    """The 5 nearest complete rows of every row missing avg_price, on
    z-scored balance, order count and finished share."""
    k = _kept(spark, sf)
    is_train = F.col("avg_price") != -9
    z = zscore(k.select("id", "avg_price", *JOIN_FEATS), JOIN_FEATS, train=is_train)
    nb = knn.knn_join(z.where(~is_train), z.where(is_train), JOIN_FEATS, 5)
    return nb.select("qid", "tid", _r(F.col("dist")).alias("dist"), F.col("rank").cast("int"))


# ---- J15: k-NN classifier -------------------------------------------------------------------------

CLS_FEATS = ["acctbal", "n_orders", "avg_price", "max_price", "share_f"]


def _cls_split(spark, sf):
    s = ev.hash_split(study(spark, sf), "id", 67, method="mod").select("id", "label", "is_train", *CLS_FEATS)
    is_train = F.col("is_train") == 1
    z = zscore(cut_lineage(s), CLS_FEATS, train=is_train)  # read for the scales, both parts and the truth
    return z.where(is_train), z.where(~is_train)


_CLS_SQL = f"""{STUDY_SQL},
tr AS (SELECT * FROM study WHERE id % 100 < 67), te AS (SELECT * FROM study WHERE id % 100 >= 67),
st AS (SELECT {", ".join(f"CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in CLS_FEATS)} FROM tr),
pairs AS (SELECT q.id AS qid, q.label AS qlabel, t.id AS tid, t.label AS y,
   sqrt({" + ".join(f"power((q.{c} - t.{c}) / s_{c}, 2)" for c in CLS_FEATS)}) AS dist FROM te q CROSS JOIN tr t CROSS JOIN st),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), tid) AS rank FROM pairs)"""


def _weights_sql(src: str, uniform: bool = False) -> str:
    if uniform:
        return f"SELECT *, 1.0::DOUBLE AS w FROM {src}"
    return (f"SELECT *, CASE WHEN max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, kk) = 1 "
            f"THEN CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / dist END AS w FROM {src}")


@query("knn_classify", f"""WITH {_CLS_SQL},
nb AS (SELECT *, 15 AS kk FROM rk WHERE rank <= 15), w AS ({_weights_sql('nb')}),
pc AS (SELECT qid, y, sum(w) AS ws FROM w GROUP BY qid, y),
pred AS (SELECT qid, y AS prediction FROM pc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ws DESC, y) = 1),
pr AS (SELECT qid, sum(CASE WHEN y = 1 THEN w ELSE 0 END) / sum(w) AS proba FROM w GROUP BY qid)
SELECT pred.qid AS id, round(proba, 6) AS proba, prediction FROM pred JOIN pr USING (qid)""")
def knn_classify(spark, sf):
    """Distance-weighted 15-NN on the hash split: class probability
    and predicted label of every test row."""
    tr, te = _cls_split(spark, sf)
    nb = knn.knn_join(te, tr, CLS_FEATS, 15, out_q="id", carry=["label"])
    pred = knn.vote(nb, "id", "label")
    pr = knn.class_probability(nb, "id", "label")
    return pred.join(pr, "id").select("id", _r(F.col("proba")).alias("proba"), "prediction")


#: the whole grid of the studied search: 19 odd k, both weights
KNN_GRID = KNN_GRID_FULL = [(k, w) for k in range(9, 47, 2) for w in ("uniform", "distance")]


def _grid_sql(grid) -> str:
    return f"""WITH {_CLS_SQL},
g AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{w}')" for k, w in grid)}) t(kk, weights)),
nb AS (SELECT rk.*, g.kk, g.weights FROM rk JOIN g ON rk.rank <= g.kk),
w AS (SELECT *, CASE WHEN weights = 'uniform' THEN 1.0
        WHEN max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, kk, weights) = 1
        THEN CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / dist END AS w FROM nb),
pc AS (SELECT kk, weights, qid, qlabel, y, sum(w) AS ws FROM w GROUP BY ALL),
pred AS (SELECT * FROM pc QUALIFY row_number() OVER (PARTITION BY kk, weights, qid ORDER BY ws DESC, y) = 1)
SELECT CAST(kk AS INTEGER) AS k, weights, round(avg(CASE WHEN y = qlabel THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM pred GROUP BY kk, weights"""


@query("knn_grid", _grid_sql(KNN_GRID))
def knn_grid(spark, sf):
    """J15 grid (all 19 k of the studied search x weights) scored by test
    accuracy: one join at the largest k, smaller k are rank filters of the
    same neighbours."""
    tr, te = _cls_split(spark, sf)
    kmax = max(k for k, _ in KNN_GRID)
    nb = knn.knn_join(te, tr, CLS_FEATS, kmax, out_q="id", carry=["label"]).withColumnRenamed("label", "y")
    truth = te.select("id", F.col("label").alias("truth"))
    return knn.grid_accuracy(nb, truth, "id", "y", KNN_GRID).withColumn("accuracy", _r(F.col("accuracy")))


@query("knn_grid_full", _grid_sql(KNN_GRID_FULL))
def knn_grid_full(spark, sf):
    """J15 grid over all 19 k of the studied search x weights: one join at
    the largest k and one pass over its rows for all k and weights."""
    tr, te = _cls_split(spark, sf)
    kmax = max(k for k, _ in KNN_GRID_FULL)
    nb = knn.knn_join(te, tr, CLS_FEATS, kmax, out_q="id", carry=["label"]).withColumnRenamed("label", "y")
    truth = te.select("id", F.col("label").alias("truth"))
    return knn.grid_accuracy(nb, truth, "id", "y", KNN_GRID_FULL).withColumn("accuracy", _r(F.col("accuracy")))


# ---- I4 / I5 / I7: imputation ----------------------------------------------------------------------

def _step_sql(src: str, name: str, target: str, cont: list[str], cats: list[str], kind: str) -> str:
    """One imputation step in DuckDB, brute force; ends with CTE {name}_out
    (src with the target filled) and {name}_pred (id, prediction)."""
    parts = [f"{name}_tr AS (SELECT * FROM {src} WHERE {target} <> -9)",
             f"{name}_q AS (SELECT * FROM {src} WHERE {target} = -9)",
             f"{name}_st AS (SELECT round_even(sqrt(count(*)), 0) AS k"
             + "".join(f", CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in cont)
             + f" FROM {name}_tr)"]
    for c in cats:
        parts.append(f"""{name}_iv_{c} AS (SELECT l.v AS lv,
  CASE WHEN coalesce(t.p, 0) * (1 - coalesce(t.p, 0)) = 0 THEN 1.0 ELSE 1.0 / (t.p * (1 - t.p)) END AS iv
  FROM (SELECT DISTINCT {c} AS v FROM {src}) l
  LEFT JOIN (SELECT {c} AS v, count(*) / (SELECT count(*) FROM {name}_tr)::DOUBLE AS p FROM {name}_tr GROUP BY 1) t
  ON t.v = l.v)""")
    terms = [f"power((q.{c} - t.{c}) / s.s_{c}, 2)" for c in cont]
    joins = ""
    for c in cats:
        terms.append(f"CASE WHEN q.{c} <> t.{c} THEN qi_{c}.iv + ti_{c}.iv ELSE 0 END")
        joins += (f" JOIN {name}_iv_{c} qi_{c} ON qi_{c}.lv = q.{c} JOIN {name}_iv_{c} ti_{c} ON ti_{c}.lv = t.{c}")
    parts.append(f"""{name}_pairs AS (SELECT q.id AS qid, t.id AS tid, t.{target} AS y, sqrt({" + ".join(terms)}) AS dist
  FROM {name}_q q CROSS JOIN {name}_tr t CROSS JOIN {name}_st s{joins})""")
    parts.append(f"""{name}_nb AS (SELECT * FROM {name}_pairs
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), tid) <= (SELECT k FROM {name}_st))""")
    parts.append(f"""{name}_w AS (SELECT *, CASE WHEN max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) = 1
  THEN CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / dist END AS w FROM {name}_nb)""")
    if kind == "class":
        parts.append(f"""{name}_pred AS (SELECT qid AS id, y AS prediction FROM
  (SELECT qid, y, sum(w) AS ws FROM {name}_w GROUP BY qid, y)
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ws DESC, y) = 1)""")
    else:
        parts.append(f"{name}_pred AS (SELECT qid AS id, sum(w * y) / sum(w) AS prediction FROM {name}_w GROUP BY qid)")
    parts.append(f"""{name}_out AS (SELECT s.* REPLACE (CASE WHEN p.prediction IS NULL THEN s.{target}
  ELSE CAST(p.prediction AS {'INTEGER' if kind == 'class' else 'DOUBLE'}) END AS {target})
  FROM {src} s LEFT JOIN {name}_pred p ON p.id = s.id)""")
    return ",\n".join(parts)


BASE_CONT = ["acctbal", "n_orders", "share_f"]
BASE_CATS = ["nation", "region", "big"]


def _impute_one(spark, sf, target, kind):
    k = cut_lineage(_kept(spark, sf))
    preds = impute.complete_predictors(k, ["id", target, "label"])
    pred = impute.knn_impute(k, "id", impute.ImputeSpec(target, kind), preds, CATEGORICAL, materialized=True)
    return pred


@query("knn_impute_reg", f"""WITH {_KEPT_SQL},
{_step_sql('kept', 's1', 'avg_price', BASE_CONT, BASE_CATS, 'reg')}
SELECT id, round(prediction, 6) AS prediction FROM s1_pred""")
def knn_impute_reg(spark, sf):
    """Distance-weighted k-NN mean for avg_price, k = round(sqrt(n))."""
    p = _impute_one(spark, sf, "avg_price", "reg")
    return p.select("id", _r(F.col("prediction")).alias("prediction"))


@query("knn_impute_class", f"""WITH {_KEPT_SQL},
{_step_sql('kept', 's1', 'seg', BASE_CONT, BASE_CATS, 'class')}
SELECT id, prediction FROM s1_pred""")
def knn_impute_class(spark, sf):
    """I4: distance-weighted k-NN vote for the segment code."""
    p = _impute_one(spark, sf, "seg", "class")
    return p.select("id", F.col("prediction").cast("int").alias("prediction"))


CHAIN = [impute.ImputeSpec("max_price", "reg"), impute.ImputeSpec("seg", "class"),
         impute.ImputeSpec("avg_price", "reg")]


@query("impute_chain", f"""WITH {_KEPT_SQL},
{_step_sql('kept', 'c1', 'max_price', BASE_CONT, BASE_CATS, 'reg')},
{_step_sql('c1_out', 'c2', 'seg', BASE_CONT + ['max_price'], BASE_CATS, 'class')},
{_step_sql('c2_out', 'c3', 'avg_price', BASE_CONT + ['max_price'], BASE_CATS + ['seg'], 'reg')}
SELECT id, round(max_price, 6) AS max_price, seg, round(avg_price, 6) AS avg_price FROM c3_out""")
def impute_chain(spark, sf):
    """max_price, then seg, then avg_price (ascending missing count),
    each filled column a predictor of the next step."""
    out = impute.impute_chain(_kept(spark, sf), "id", CHAIN, CATEGORICAL, exclude=["label"])
    return out.select("id", _r(F.col("max_price")).alias("max_price"), "seg", _r(F.col("avg_price")).alias("avg_price"))
