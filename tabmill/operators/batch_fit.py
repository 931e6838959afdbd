"""Many logistic regressions in one pass per Newton step (survey J3, J5, J6, J10, J20).

A search fits the same table many times: per fold or split, cost and feature
set.  Here all these fits run together.  Every step is one aggregate over the
table: a task multiplies its rows with the coefficients of all fits at once
and sums up each fit's loss, gradient and information over the rows that
train it; the sums (one row per fit and partition) are added up in Spark, and
a few numbers per fit reach the driver, which takes the step.  A fit that
has converged leaves the pass.

A fit minimises C times the summed log-loss plus half the squared
coefficients (the intercept is free), as a cost C does elsewhere in this
package.  Steps that raise it are halved.

Rows with a null or NaN feature or label are not used (and get no score).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabmill.session import cut_lineage

#: Largest number of parts (folds or splits) that a row's training bits can tell apart.
MAX_PARTS = 62
#: A fit has converged when no component of its gradient per row exceeds this.
TOLERANCE = 1e-9


@dataclass(frozen=True)
class Fit:
    """One regression: a name, its columns, its cost (None: no penalty) and the part that says which rows train it."""

    name: str
    columns: tuple[str, ...]
    cost: float | None = 1.0
    part: int = 0


@dataclass
class Fitted:
    """Coefficients by column ('' is the intercept), rows, log-loss, and the full gradient and information at the end."""

    fit: Fit
    coef: dict[str, float]
    n: int
    loss: float
    converged: bool
    gradient: np.ndarray = field(repr=False)
    information: np.ndarray = field(repr=False)


def table(df: DataFrame, id_col: str, label: str, columns: Sequence[str], bits: F.Column) -> DataFrame:
    """id, y, x (1 and the columns) and bits (which parts a row trains), written once."""
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns])
    rows = df.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y"), x.alias("x"), bits.cast("long").alias("bits"))
    return cut_lineage(rows.where(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))), min_partitions=True)


def fold_bits(fold: str, k: int) -> F.Column:
    """Training bits for folds 1 to k: a row trains every part but its own fold."""
    return F.lit((1 << (k + 1)) - 2) - F.expr(f"shiftleft(1L, CAST(`{fold}` AS INT))")


def _matrix(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    return x, b.column("y").to_numpy(), b.column("bits").to_numpy()


def _sums(rows: DataFrame, parts: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per fit (rows of w): n, loss, gradient and information over the rows that train it."""
    m, d = w.shape
    sent = rows.sparkSession.sparkContext.broadcast((parts, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, w = sent.value
        total = np.zeros((m, 2 + d + d * d))
        for b in batches:
            if not b.num_rows:
                continue
            x, y, bits = _matrix(b)
            z = x @ w.T
            used = (bits[:, None] >> parts) & 1 == 1
            p = 0.5 * (1.0 + np.tanh(0.5 * z))
            total[:, 0] += used.sum(axis=0)
            total[:, 1] += np.where(used, np.logaddexp(0.0, z) - y[:, None] * z, 0.0).sum(axis=0)
            total[:, 2:2 + d] += np.where(used, p - y[:, None], 0.0).T @ x
            weight = np.where(used, p * (1.0 - p), 0.0)
            for j in range(m):
                total[j, 2 + d:] += (x.T @ (x * weight[:, j, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array(list(total), pa.list_(pa.float64()))], ["fit", "sums"])
    partial = rows.mapInArrow(run, "fit long, sums array<double>").select("fit", F.posexplode("sums"))
    out = np.zeros((m, 2 + d + d * d))
    added = partial.groupBy("fit", "pos").agg(F.sum("col").alias("s")).toArrow()
    out[added["fit"].to_numpy(), added["pos"].to_numpy()] = added["s"].to_numpy()
    return out


def fit_all(rows: DataFrame, columns: Sequence[str], fits: Sequence[Fit], steps: int = 100) -> list[Fitted]:
    """All ``fits`` on the table that ``table`` made of ``columns``.  A fit
    that has not converged after ``steps`` (separable classes without a
    penalty) says so in ``converged``."""
    d = len(columns) + 1
    spot = {c: k for k, c in enumerate(columns, 1)}
    if any(not 0 <= f.part < MAX_PARTS for f in fits):
        raise ValueError(f"parts are numbered from 0 to {MAX_PARTS - 1}")
    own = [np.array([0, *(spot[c] for c in f.columns)]) for f in fits]
    w, step = np.zeros((len(fits), d)), np.zeros((len(fits), d))
    best = np.full(len(fits), math.inf)
    found: list[Fitted | None] = [None] * len(fits)
    todo = list(range(len(fits)))
    for turn in range(steps + 1):
        sums = _sums(rows, np.array([fits[j].part for j in todo]), w[todo])
        left = []
        for j, s in zip(todo, sums):
            f, at = fits[j], own[j]
            n, loss, g, h = int(s[0]), s[1], s[2:2 + d], s[2 + d:].reshape(d, d)
            cost = 1.0 if f.cost is None else f.cost
            ridge = np.full(len(at), 0.0 if f.cost is None else 1.0)
            ridge[0] = 0.0
            goal = cost * loss + 0.5 * (ridge * w[j, at] ** 2).sum()
            if goal > best[j] * (1 + 1e-12) + 1e-12 and np.abs(step[j]).max() > 1e-12:
                step[j] /= 2.0
                w[j] -= step[j]
                left.append(j)
                continue
            best[j] = goal
            slope = cost * g[at] + ridge * w[j, at]
            done = np.abs(slope).max() <= TOLERANCE * cost * max(1, n)
            found[j] = Fitted(f, dict(zip(["", *f.columns], w[j, at].tolist())), n, float(loss), bool(done), g, h)
            if not done and n:
                step[j] = 0.0
                step[j, at] = -np.linalg.lstsq(cost * h[np.ix_(at, at)] + np.diag(ridge), slope, rcond=None)[0]
                w[j] += step[j]
                left.append(j)
        todo = left
        if not todo:
            break
    return found


def _weights(fitted: Sequence[Fitted], columns: Sequence[str]) -> np.ndarray:
    spot = {"": 0} | {c: k for k, c in enumerate(columns, 1)}
    w = np.zeros((len(fitted), len(columns) + 1))
    for j, f in enumerate(fitted):
        for c, v in f.coef.items():
            w[j, spot[c]] = v
    return w


def out_of_part(rows: DataFrame, columns: Sequence[str], fitted: Sequence[Fitted]) -> DataFrame:
    """(id, label, model, part, p): every row's probability by each fit that it did not train."""
    sent = rows.sparkSession.sparkContext.broadcast((_weights(fitted, columns), np.array([f.fit.part for f in fitted]), [f.fit.name for f in fitted]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, parts, names = sent.value
        for b in batches:
            if b.num_rows:
                x, y, bits = _matrix(b)
                i, j = np.nonzero((bits[:, None] >> parts) & 1 == 0)
                p = 0.5 * (1.0 + np.tanh(0.5 * (x @ w.T)))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(i)), pa.array(y[i].astype(np.int32)), pa.array(names).take(pa.array(j)),
                                                  pa.array(parts[j].astype(np.int32)), pa.array(p[i, j])], ["id", "label", "model", "part", "p"])
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label int, model string, part int, p double")


def accuracy(scores: DataFrame) -> DataFrame:
    """(model, accuracy): the mean over the parts of the share of rows on the right side of one half."""
    right = F.avg(((F.col("p") > 0.5).cast("int") == F.col("label")).cast("double"))
    return scores.groupBy("model", "part").agg(right.alias("a")).groupBy("model").agg(F.avg("a").alias("accuracy"))


def forward_by_score(rows: DataFrame, columns: Sequence[str], groups: dict[str, Sequence[str]], alpha: float, part: int = 0) -> list[tuple[str, float, float]]:
    """J10 by score tests: (variable, statistic, p) in the order of entry.

    At the fit of the variables that are in, the gradient and information of
    all columns (one aggregate) give every candidate's score statistic; the
    one with the smallest p enters while p < alpha.  So a step costs one fit
    whatever the number of candidates.  A group of columns enters as one
    variable with as many degrees of freedom as its information has rank."""
    from tabmill.functions.pvalues import chi2_sf
    spark = rows.sparkSession
    spot = {c: k for k, c in enumerate(columns, 1)}
    chosen: list[str] = []
    path = []
    while len(chosen) < len(groups):
        f = fit_all(rows, columns, [Fit("step", tuple(c for v in chosen for c in groups[v]), None, part)])[0]
        inside = [0, *(spot[c] for v in chosen for c in groups[v])]
        tests = []
        for v in groups:
            if v not in chosen:
                own = [spot[c] for c in groups[v]]
                cross = f.information[np.ix_(own, inside)]
                rest = f.information[np.ix_(own, own)] - cross @ np.linalg.pinv(f.information[np.ix_(inside, inside)]) @ cross.T
                g = f.gradient[own]
                tests.append((v, float(g @ np.linalg.pinv(rest, hermitian=True) @ g), int(np.linalg.matrix_rank(rest, hermitian=True))))
        known = [t for t in tests if t[2]]
        if not known:
            break
        table = spark.createDataFrame([(v, s, float(dof)) for v, s, dof in known], "v string, s double, dof double")
        ranked = sorted((r["p"], -r["s"], r["v"]) for r in table.select("v", "s", chi2_sf(F.col("s"), F.col("dof")).alias("p")).collect())
        p, s, v = ranked[0]
        if not p < alpha:
            break
        path.append((v, -s, p))
        chosen.append(v)
    return path
