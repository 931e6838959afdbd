"""Distribution operators: moments, normality test, Box-Cox, z-scores, a
two-column principal component, kernel density and normal-fit curves
(survey D18, H2, H3, H7, H8, H13, H14).

Each is one or a few aggregates over the data plus column arithmetic; density
points are attached by ``explode`` of a bounded per-row range, never by a
cross join with the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def _long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keep), list(cols), "variable", "x")


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """N, population skewness and excess kurtosis per column."""
    long = _long(df, cols)
    return long.groupBy("variable").agg(F.count("x").alias("n"), F.skewness("x").alias("skewness"),
                                        F.kurtosis("x").alias("kurtosis"))


def normality_z(n: Column, g1: Column, g2: Column) -> tuple[Column, Column]:
    """D'Agostino skewness Z and Anscombe-Glynn kurtosis Z (population g1 and
    excess kurtosis g2; the published formulas)."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2.0 / (w2 - 1))
    y = F.when(y == 0, F.lit(1.0)).otherwise(y)
    z1 = delta * F.log(y / alpha + F.sqrt(F.pow(y / alpha, 2) + 1))
    b2 = g2 + 3.0
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(varb2)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1 + 4.0 / (sb1 * sb1)))
    term1 = 1 - 2 / (9.0 * a)
    denom = 1 + x * F.sqrt(2 / (a - 4.0))
    term2 = F.signum(denom) * F.pow((1 - 2.0 / a) / F.abs(denom), F.lit(1 / 3.0))
    z2 = (term1 - term2) / F.sqrt(2 / (9.0 * a))
    return z1, z2


def normality(df: DataFrame, cols: Sequence[str], alpha: Column | float) -> DataFrame:
    """H2: omnibus K2 = Z1^2 + Z2^2, p = exp(-K2/2) (chi-square, 2 dof);
    reject when p < alpha."""
    m = moments(df, cols)
    z1, z2 = normality_z(F.col("n"), F.col("skewness"), F.col("kurtosis"))
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    out = m.withColumns({"z_skew": z1, "z_kurt": z2})
    out = out.withColumn("k2", F.col("z_skew") ** 2 + F.col("z_kurt") ** 2)
    out = out.withColumn("p_value", F.exp(-F.col("k2") / 2))
    return out.withColumn("reject", (F.col("p_value") < a).cast("int"))


def _yl(z: Column, lam: Column) -> Column:
    return F.when(lam == 0, F.log(z)).otherwise((F.pow(z, lam) - 1) / lam)


def _yl_parts(lam: Column, u: Column) -> list[Column]:
    """y_lambda of z = exp(u) and its first two derivatives by lambda.

    With t = lambda u they are u f(t), u^2 f'(t) and u^3 f''(t) for
    f(t) = (e^t - 1) / t; near t = 0 by their series, where the closed forms
    cancel."""
    t, e = lam * u, F.exp(lam * u)
    closed = [(e - 1) / t, (e * (t - 1) + 1) / (t * t), (e * (t * t - 2 * t + 2) - 2) / (t * t * t)]
    out = []
    for d in range(3):
        series = F.lit(0.0)
        for k in range(d + 10, d - 1, -1):  # Horner's rule
            series = series * t + F.lit(math.perm(k, d) / math.factorial(k + 1))
        out.append(F.pow(u, F.lit(d + 1)) * F.when(F.abs(t) < 0.1, series).otherwise(closed[d]))
    return out


@dataclass
class _Root:
    """Safeguarded Newton search for the minimum of a function of one number."""

    at: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = False

    def step(self, slope: float, curve: float) -> None:
        """Move on from the slope and curvature at ``at`` (not finite: too far out)."""
        if not (math.isfinite(slope) and math.isfinite(curve)):
            slope, curve = math.copysign(1.0, self.at), 0.0
        if slope > 0:
            self.high = self.at
        else:
            self.low = self.at
        to = self.at - slope / curve if curve > 0 else math.nan
        if not self.low < to < self.high:
            inside = math.isfinite(self.low) and math.isfinite(self.high)
            to = (self.low + self.high) / 2 if inside else self.at - math.copysign(max(1.0, abs(self.at)), slope)
        self.done = slope == 0 or abs(to - self.at) <= 1e-7 * max(1.0, abs(to))
        self.at = to if slope else self.at


def boxcox_lambda(df: DataFrame, cols: Sequence[str] | None = None, long: DataFrame | None = None) -> DataFrame:
    """H3: maximum-likelihood Box-Cox lambda per column, to three digits.

    Up to a constant the log-likelihood of lambda on x equals minus n/2 ln
    var_pop(y) for y = y_lambda(x / gm) with gm the geometric mean.  Its first
    two derivatives come from four central moments (the variances of y and y',
    the covariances of y with y' and y''), so a Newton step for all columns is
    one aggregate; steps that leave the bracket kept by the slopes' signs are
    replaced by bisection.  A last aggregate compares the two neighbouring
    values of three digits.  Between the steps a few numbers per column go to
    the driver, like any fitted parameter.

    Columns with a value <= 0 get lambda NULL and positive = 0 (the transform
    is undefined there), columns of one value lambda NULL (every lambda is as
    likely).  Nulls are left out.
    """
    from tabmill.session import cut_lineage
    data = long if long is not None else _long(df, cols)
    data = data.select("variable", F.col("x").cast("double").alias("x")).where(F.col("x").isNotNull())
    st = cut_lineage(data.groupBy("variable").agg(F.count("x").alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"),
                                                  F.avg(F.when(F.col("x") > 0, F.log("x"))).alias("mlog")))
    mean = {r["variable"]: r["mlog"] for r in st.where("mn > 0 AND mn < mx").collect()}  # one row per column
    result = st.select("variable", "n", (F.col("mn") > 0).cast("int").alias("positive"))
    if not mean:
        return result.withColumn("bc_lambda", F.lit(None).cast("double"))

    def each(values: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for v, y in values.items() for x in (v, float(y))])[F.col("variable")]

    logs = cut_lineage(data.where(F.col("variable").isin(list(mean))).select("variable", (F.log("x") - each(mean)).alias("u")), min_partitions=True)
    roots = {v: _Root() for v in mean}
    while todo := {v: r.at for v, r in roots.items() if not r.done}:
        y, y1, y2 = _yl_parts(F.col("lam"), F.col("u"))
        parts = (logs.where(F.col("variable").isin(list(todo))).withColumn("lam", each(todo))
                 .select("variable", y.alias("y"), y1.alias("y1"), y2.alias("y2")))
        for r in parts.groupBy("variable").agg(F.var_pop("y").alias("v"), F.covar_pop("y", "y1").alias("c1"),
                                               F.var_pop("y1").alias("v1"), F.covar_pop("y", "y2").alias("c2")).collect():
            v = r["v"] or math.nan
            slope = 2 * r["c1"] / v
            roots[r["variable"]].step(slope, 2 * (r["v1"] + r["c2"]) / v - slope * slope)
    low = {v: math.floor(r.at * 1000) / 1000 for v, r in roots.items()}
    high = {v: (math.floor(r.at * 1000) + 1) / 1000 for v, r in roots.items()}
    sides = logs.select("variable", *[_yl_parts(each(side), F.col("u"))[0].alias(k) for k, side in (("a", low), ("b", high))])
    better = {r["variable"]: (high if r["b"] < r["a"] else low)[r["variable"]]
              for r in sides.groupBy("variable").agg(F.var_pop("a").alias("a"), F.var_pop("b").alias("b")).collect()}
    return result.withColumn("bc_lambda", F.round(each(better), 3))


def boxcox_apply(x: Column, lam: Column) -> Column:
    """H3: y = (x^lambda - 1) / lambda, ln x at lambda = 0."""
    return _yl(x.cast("double"), lam)


def zscore_fit(df: DataFrame, cols: Sequence[str], train: Column | None = None) -> dict[str, tuple[float, float]]:
    """H7 fit: mean and population std per column over the ``train`` rows,
    one aggregate whose one-row result (2 numbers per column) is the fitted
    model.  A zero or undefined std scales by 1."""
    fit = df.where(train) if train is not None else df
    row = fit.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, sd = row[f"m_{i}"], row[f"s_{i}"]
        out[c] = (float(m) if m is not None else 0.0, float(sd) if sd else 1.0)
    return out


def zscore_apply(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """H7 apply: (x - mean) / std with the fitted literals."""
    return df.withColumns({c + suffix: F.expr(f"(`{c}` - CAST('{m!r}' AS DOUBLE)) / CAST('{sd!r}' AS DOUBLE)")
                           for c, (m, sd) in params.items()})


def zscore(df: DataFrame, cols: Sequence[str], train: Column | None = None, suffix: str = "") -> DataFrame:
    """H7: z-scores fitted on the ``train`` rows (all rows if None) and
    applied to every row."""
    return zscore_apply(df, zscore_fit(df, cols, train), suffix)


def pca1(df: DataFrame, a: str, b: str, name: str = "pca") -> DataFrame:
    """H8: first principal component score of two columns (centred), closed
    form: t = atan2(2 cov, var_a - var_b) / 2; sign fixed so the larger
    loading is positive."""
    st = df.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"),
                F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("cab"))
    s = st.select(F.struct(*st.columns).alias("s")).scalar()
    t = 0.5 * F.atan2(2 * s["cab"], s["va"] - s["vb"])
    ca, sa = F.cos(t), F.sin(t)
    flip = F.when((F.abs(sa) > F.abs(ca)) & (sa < 0), F.lit(-1.0)).otherwise(F.lit(1.0))
    score = ((F.col(a) - s["ma"]) * ca + (F.col(b) - s["mb"]) * sa) * flip
    return df.withColumn(name, score)


def kde(df: DataFrame, col: str, points: int = 50, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on ``points`` grid points over
    [min - cut h, max + cut h], Scott bandwidth h = n^(-1/5) std (n-1).

    Data are first reduced to (value, count); each value then meets only
    the grid points within 39 h - beyond that exp(-z^2/2) underflows to
    exactly 0.0 - so the work is O(distinct values x points in reach), with
    one partial aggregate per grid point.
    """
    x = F.col(col).cast("double")
    st = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    s = st.select(F.struct(*st.columns).alias("s")).scalar()
    h = F.pow(s["n"].cast("double"), -0.2) * s["sd"]
    g0 = s["lo"] - cut * h
    step = (s["hi"] - s["lo"] + 2 * cut * h) / (points - 1)
    vals = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    reach = 39.0 * h
    i_lo = F.greatest(F.ceil((F.col("v") - reach - g0) / step), F.lit(0)).cast("int")
    i_hi = F.least(F.floor((F.col("v") + reach - g0) / step), F.lit(points - 1)).cast("int")
    near = vals.where(i_lo <= i_hi).withColumn("i", F.explode(F.sequence(i_lo, i_hi)))
    gx = g0 + F.col("i") * step
    contrib = near.groupBy("i").agg(F.sum(F.col("c") * F.exp(-0.5 * F.pow((gx - F.col("v")) / h, 2))).alias("k"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    out = grid.join(contrib, "i", "left").fillna(0.0, ["k"])
    return out.select("i", (g0 + F.col("i") * step).alias("x"),
                      (F.col("k") / (s["n"] * h * math.sqrt(2 * math.pi))).alias("density"))


def normal_fit(df: DataFrame, col: str, points: int = 50) -> DataFrame:
    """Normal density with the fitted mean and population std on
    ``points`` grid points from min to max."""
    x = F.col(col).cast("double")
    st = df.agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    s = st.select(F.struct(*st.columns).alias("s")).scalar()
    step = (s["hi"] - s["lo"]) / (points - 1)
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    gx = s["lo"] + F.col("i") * step
    dens = F.exp(-0.5 * F.pow((gx - s["mu"]) / s["sd"], 2)) / (s["sd"] * math.sqrt(2 * math.pi))
    return grid.select("i", gx.alias("x"), dens.alias("density"))
