"""Nearest-neighbour imputation of sentinel-marked cells (survey I3-I8, J15).

One step: predictors = the columns complete *now* (minus excluded ones),
categorical predictors one-hot encoded over all rows, everything z-scored
with mean / population std of the training rows (rows whose target is
known), k = round-half-even(sqrt(n_train)) (optionally forced odd), the k
nearest training rows found by the exact index search in ``knn``, then a
distance-weighted vote (classes; ties -> lowest) or mean (values,
optionally rounded half-to-even).  The chain imputes columns in ascending
order of their missing count, each filled column joining the predictors of
the next step; every step is checkpointed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tabmill.operators import knn
from tabmill.operators.dist import zscore
from tabmill.operators.profile import SENTINEL
from tabmill.session import cut_lineage

MAX_LEVELS_ONE_HOT = 1000


@dataclass(frozen=True)
class ImputeSpec:
    target: str
    kind: str                 # 'class' or 'reg'
    round_digits: int | None = None
    force_odd: bool = False


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = False,
            levels: dict | None = None) -> tuple[DataFrame, list[str]]:
    """``one_hot_groups`` with the new columns in one list."""
    out, groups = one_hot_groups(df, cols, drop_first, levels)
    return out, [d for c in cols for d in groups[c]]


def one_hot_groups(df: DataFrame, cols: Sequence[str], drop_first: bool = False,
                   levels: dict | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """0/1 column per level, named ``col_level``, and the map from
    each variable to its columns (in order); the level lists
    come from one distinct-values aggregate per column (a categorical's
    domain, guarded by ``MAX_LEVELS_ONE_HOT``).  ``drop_first`` drops the
    smallest level (the regression-design variant)."""
    levels = dict(levels or {})
    names: dict[str, list[str]] = {c: [] for c in cols}
    out: dict = {}
    todo = [c for c in cols if c not in levels]
    if todo:
        # one distributed distinct over (column, value) pairs for all columns
        # of a type, capped: a categorical's domain, never an unbounded collect
        got: dict[str, list] = {c: [] for c in todo}
        for kind in {df.schema[c].dataType for c in todo}:  # an array holds values of one type
            same = [c for c in todo if df.schema[c].dataType == kind]
            pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in same]))
                              .alias("p")).select("p.c", "p.v").distinct()
            for r in pairs.limit(MAX_LEVELS_ONE_HOT * len(same) + 1).collect():
                got[r["c"]].append(r["v"])
        for c in todo:
            if len(got[c]) > MAX_LEVELS_ONE_HOT:
                raise ValueError(f"{c}: more than {MAX_LEVELS_ONE_HOT} levels; not categorical")
            levels[c] = sorted(v for v in got[c] if v is not None)
    for c in cols:
        lv = levels[c][1:] if drop_first else levels[c]
        for v in lv:
            name = f"{c}_{v}"
            while name in out or name in df.columns and name not in cols:
                name += "_"  # another variable's level has this name
            out[name] = (F.col(c) == F.lit(v)).cast("int")
            names[c].append(name)
    return df.withColumns(out).drop(*cols), names


def complete_predictors(df: DataFrame, exclude: Sequence[str], sentinel=SENTINEL) -> list[str]:
    """Columns with no sentinel cell now (one aggregate, one row)."""
    cols = [c for c in df.columns if c not in set(exclude)]
    row = df.agg(*[F.count_if(F.col(c) == sentinel).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] == 0]


def knn_impute(df: DataFrame, id_col: str, spec: ImputeSpec, predictors: Sequence[str],
               categorical: Sequence[str], sentinel=SENTINEL,
               materialized: bool = False) -> DataFrame:
    """(id, prediction) for every row whose target is the
    sentinel.  ``materialized`` says the input is already a cut table."""
    t = spec.target
    # the fit steps below (levels, scaler, grid) each read the input: read it once
    base = df.select(id_col, t, *predictors)
    if not materialized:
        base = cut_lineage(base)
    cats = [c for c in predictors if c in set(categorical)]
    enc, dummies = one_hot_groups(base, cats)
    feats = [c for c in predictors if c not in set(cats)] + [d for c in cats for d in dummies[c]]
    is_train = F.col(t) != sentinel
    z = cut_lineage(zscore(enc, feats, train=is_train))
    train = z.where(is_train)
    query = z.where(~is_train)

    def k_of(n_train: int) -> int:
        k = int(round(n_train ** 0.5))          # Python round: half to even
        if spec.force_odd and k % 2 == 0:
            k -= 1
        return max(k, 1)

    # k grows with the table: the neighbours are summed where they are found, not handed on as rows
    sums = knn.knn_sums(query, train, feats, k_of, t, id_col, id_col, by_value=spec.kind == "class")
    if spec.kind == "class":
        pred = knn.vote_of_sums(sums, id_col, t)
    else:
        pred = knn.mean_of_sums(sums, id_col)
        if spec.round_digits is not None:
            pred = pred.withColumn("prediction", F.bround("prediction", spec.round_digits))
    return pred


def apply_imputation(df: DataFrame, id_col: str, target: str, pred: DataFrame) -> DataFrame:
    """Write predictions back into the sentinel cells (B5 as a join on id)."""
    p = pred.select(F.col(id_col), F.col("prediction").alias("__p"))
    out = df.join(p, id_col, "left")
    typ = df.schema[target].dataType
    return out.withColumn(target, F.coalesce(F.col("__p").cast(typ), F.col(target))).drop("__p").select(*df.columns)


def impute_chain(df: DataFrame, id_col: str, specs: Sequence[ImputeSpec], categorical: Sequence[str],
                 exclude: Sequence[str] = (), sentinel=SENTINEL) -> DataFrame:
    """Impute the spec'd columns in ascending order of missing count;
    each step's predictors are the columns complete at that point."""
    by_name = {s.target: s for s in specs}
    df = cut_lineage(df)
    counts = df.agg(*[F.count_if(F.col(s.target) == sentinel).alias(s.target) for s in specs]).first()
    order = sorted(by_name, key=lambda c: (counts[c], c))
    cur = df
    # columns complete now: found once, then each imputed column joins them
    complete = complete_predictors(cur, [id_col, *exclude], sentinel)
    for target in order:
        if counts[target] == 0:
            continue
        preds = [c for c in cur.columns if c in set(complete) and c != target]
        p = knn_impute(cur, id_col, by_name[target], preds, categorical, sentinel, materialized=True)
        cur = cut_lineage(apply_imputation(cur, id_col, target, p))
        complete.append(target)
    return cur
