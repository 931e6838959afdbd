"""Kernel support vector classifiers on Nystroem features (survey J14).

A bounded sample of rows (the landmarks) spans the kernel's feature space:
with K the kernel between landmarks, a row's features are its kernel values
with them times K^(-1/2), whose products give the kernel back exactly where
the landmarks hold all rows and approximately otherwise.  On these features a
classifier minimises half the squared weights plus C times the summed hinge
loss (the intercept is free), as a kernel SVC of cost C does.

The hinge is rounded off around its corner by a parabola of a width that
shrinks from step to step, so Newton's method applies; at the last width the
decision values are those of the hinge to a few ten-thousandths.  A step of
all fits (kernel, gamma, cost, part) is two passes over the table: in the
first a task adds up gradient and information of all fits, in the second the
losses at all step lengths of a ladder, of which the best is taken.  The sums
are added up in Spark, and the driver, which gets a few sums per fit, solves
for the step.  A fit that has converged leaves the passes.

The landmarks are the rows with the smallest digests of their ids, whatever
part they are in; labels are not looked at for them.  The sigmoid kernel is
not positive definite: directions in which its landmark matrix has no
positive eigenvalue are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows that span the feature space: a bound on the sample, not on the rows that are fitted or scored.
LANDMARKS = 128
#: Widths of the rounded corner, one after the other, and the Newton steps taken at each but the last.
WIDTHS, STEPS_PER_WIDTH = (4.0, 0.4, 0.04, 0.004, 0.0004), 3
#: Lengths of a step that are tried at once.
LADDER = np.array([0.0, *(f / 2 ** k for k in range(16) for f in (1.0, 0.75))])
#: A fit has converged when no component of its gradient per row exceeds this.
TOLERANCE = 1e-7
#: Eigenvalues of the landmark matrix below this share of the largest count as zero.
RANK = 1e-10
#: Partial sums of a fit that meet in one task of the first round.
FAN_IN = 64


@dataclass(frozen=True)
class Svc:
    """One classifier: a name, its kernel ('rbf' or 'sigmoid'), gamma, cost and the part that says which rows train it."""

    name: str
    kernel: str = "rbf"
    gamma: float = 1.0
    cost: float = 1.0
    part: int = 0


@dataclass(frozen=True)
class Basis:
    """Landmarks and the matrix that turns kernel values with them into features."""

    kernel: str
    gamma: float
    landmarks: np.ndarray = field(repr=False)
    whiten: np.ndarray = field(repr=False)

    def features(self, x: np.ndarray) -> np.ndarray:
        """1 (for the intercept) and the features of each row."""
        z = kernel_values(self.kernel, self.gamma, x, self.landmarks) @ self.whiten
        return np.hstack([np.ones((len(x), 1)), z])


@dataclass
class FittedSvc:
    """Weights (the first is the intercept) on a basis, rows that trained them, and whether the fit converged."""

    fit: Svc
    basis: Basis
    weights: np.ndarray = field(repr=False)
    n: int = 0
    converged: bool = False


def kernel_values(kernel: str, gamma: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if kernel == "rbf":
        d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2.0 * x @ y.T
        return np.exp(-gamma * np.maximum(d, 0.0))
    if kernel == "sigmoid":
        return np.tanh(gamma * (x @ y.T))
    raise ValueError(f"unknown kernel {kernel}")


def landmarks(rows: DataFrame, n: int = LANDMARKS) -> np.ndarray:
    """The features of ``n`` rows (all, if there are fewer) of the table that ``batch_fit.table`` made."""
    some = rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n).select("x").collect()
    return np.array([r["x"][1:] for r in some], float) if some else np.zeros((0, 0))


def basis(kernel: str, gamma: float, marks: np.ndarray) -> Basis:
    k = kernel_values(kernel, gamma, marks, marks)
    value, vector = np.linalg.eigh((k + k.T) / 2.0)
    keep = value > RANK * max(value.max(initial=0.0), 0.0)
    return Basis(kernel, gamma, marks, vector[:, keep] / np.sqrt(value[keep]))


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels as -1 and 1, training bits."""
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    return x[:, 1:], np.where(b.column("y").to_numpy() > 0, 1.0, -1.0), b.column("bits").to_numpy()


def _corner(t: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rounded hinge of t = 1 - y f: value, derivative, and where it is curved."""
    curved = np.abs(t) < width / 2
    return (np.where(curved, (t + width / 2) ** 2 / (2 * width), np.maximum(t, 0.0)),
            np.where(curved, t / width + 0.5, (t > 0).astype(float)), curved)


def _part_sums(base: Basis, x: np.ndarray, y: np.ndarray, bits: np.ndarray, todo: Sequence[tuple], total: dict[int, np.ndarray]) -> None:
    """Adds a batch's sums to each fit of ``todo``: n, gradient and information or, where it has a step, the losses along the ladder."""
    z = base.features(x)
    for fit, _, part, width, w, step in todo:
        used = (bits >> part) & 1 == 1
        f = z @ w
        if step is not None:
            g = z @ step
            for i, t in enumerate(LADDER):
                total[fit][i] += _corner(1.0 - y * (f + t * g), width)[0][used].sum()
            continue
        _, slope, curved = _corner(1.0 - y * f, width)
        s, d = total[fit], len(w)
        s[0] += used.sum()
        s[1:1 + d] -= (slope * y * used) @ z
        near = z[curved & used]
        s[1 + d:] += (near.T @ near).ravel() / width


def _sums(rows: DataFrame, bases: Sequence[Basis], todo: Sequence[tuple]) -> dict[int, np.ndarray]:
    """The sums of each fit of ``todo`` (fit, basis, part, width, weights, step or None) over the table."""
    sent = rows.sparkSession.sparkContext.broadcast((list(bases), list(todo)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        bases, todo = sent.value
        total = {fit: np.zeros(len(LADDER) if step is not None else 1 + len(w) + len(w) ** 2) for fit, _, _, _, w, step in todo}
        seen = False
        for b in batches:
            if b.num_rows:
                seen = True
                x, y, bits = _batch(b)
                for k, base in enumerate(bases):
                    if own := [t for t in todo if t[1] == k]:
                        _part_sums(base, x, y, bits, own, total)
        if seen:
            bucket = TaskContext.get().partitionId() // FAN_IN
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([bucket] * len(total), pa.int32()),
                                              pa.array([v.tobytes() for v in total.values()], pa.binary())], ["fit", "bucket", "sums"])

    def add(p: pd.DataFrame) -> pd.DataFrame:
        out = p.iloc[:1].copy()
        out["sums"] = [np.sum([np.frombuffer(v) for v in p["sums"]], axis=0).tobytes()]
        return out
    schema = "fit int, bucket int, sums binary"
    added = rows.mapInArrow(run, schema)
    if rows.rdd.getNumPartitions() > FAN_IN:
        added = added.groupBy("fit", "bucket").applyInPandas(add, schema)
    added = added.groupBy("fit").applyInPandas(add, schema).toArrow()  # one sum per fit
    out = {fit: np.frombuffer(v) for fit, v in zip(added["fit"].to_pylist(), added["sums"].to_pylist())}
    sent.unpersist()
    return out


def fit_all(rows: DataFrame, fits: Sequence[Svc], marks: np.ndarray, steps: int = 150) -> list[FittedSvc]:
    """All ``fits`` on the table that ``batch_fit.table`` made, in the same
    passes.  A fit that has not converged after ``steps`` says so."""
    kinds = sorted({(f.kernel, f.gamma) for f in fits})
    bases = [basis(k, g, marks) for k, g in kinds]
    found = [FittedSvc(f, bases[kinds.index((f.kernel, f.gamma))], np.zeros(0)) for f in fits]
    for f in found:
        f.weights = np.zeros(1 + f.basis.whiten.shape[1])
    level, tried = [0] * len(fits), [0] * len(fits)
    todo = list(range(len(fits)))

    def task(j: int, step: np.ndarray | None = None) -> tuple:
        return j, kinds.index((fits[j].kernel, fits[j].gamma)), fits[j].part, WIDTHS[level[j]], found[j].weights, step

    for _ in range(steps):
        if not todo:
            break
        going: dict[int, np.ndarray] = {}
        waiting = []
        for j, s in _sums(rows, bases, [task(j) for j in todo]).items():
            f, w, cost = found[j], found[j].weights, fits[j].cost
            d, last = len(w), level[j] == len(WIDTHS) - 1
            ridge = np.r_[0.0, np.ones(d - 1)]
            f.n = int(s[0])
            slope = cost * s[1:1 + d] + ridge * w
            done = np.abs(slope).max() <= TOLERANCE * cost * max(1, f.n)
            if last and done:
                f.converged = True
            elif not last and (done or tried[j] >= STEPS_PER_WIDTH):
                level[j], tried[j] = level[j] + 1, 0
                waiting.append(j)
            else:
                information = cost * s[1 + d:].reshape(d, d) + np.diag(ridge)
                information[0, 0] += 1e-9 if information[0, 0] else 1e-2 * cost * max(1, f.n)  # no row on the corner: a short step
                going[j] = -np.linalg.solve(information, slope)
        todo = waiting
        if not going:
            continue
        for j, loss in _sums(rows, bases, [task(j, step) for j, step in going.items()]).items():
            w, step = found[j].weights, going[j]
            along = w[1:] + LADDER[:, None] * step[1:]
            best = LADDER[(fits[j].cost * loss + 0.5 * (along * along).sum(axis=1)).argmin()]
            if best or level[j] < len(WIDTHS) - 1:  # where no length helps at the last width, rounding has been reached
                found[j].weights = w + best * step
                tried[j] = tried[j] + 1 if best else STEPS_PER_WIDTH
                todo.append(j)
        todo.sort()
    return found


def out_of_part(rows: DataFrame, fitted: Sequence[FittedSvc]) -> DataFrame:
    """(id, label, model, part, decision): every row by each classifier that it did not train."""
    sent = rows.sparkSession.sparkContext.broadcast(list(fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y, bits = _batch(b)
            last, z = None, None
            for f in sorted(sent.value, key=lambda f: (f.basis.kernel, f.basis.gamma)):
                if f.basis is not last:
                    last, z = f.basis, f.basis.features(x)
                at = np.flatnonzero((bits >> f.fit.part) & 1 == 0)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id").take(pa.array(at)), pa.array((y[at] > 0).astype(np.int32)), pa.array([f.fit.name] * len(at)),
                         pa.array(np.full(len(at), f.fit.part, np.int32)), pa.array(z[at] @ f.weights)], ["id", "label", "model", "part", "decision"])
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label int, model string, part int, decision double")


def accuracy(scores: DataFrame) -> DataFrame:
    """(model, accuracy): the mean over the parts of the share of rows on the right side of zero."""
    right = F.avg(((F.col("decision") > 0).cast("int") == F.col("label")).cast("double"))
    return scores.groupBy("model", "part").agg(right.alias("a")).groupBy("model").agg(F.avg("a").alias("accuracy"))
