"""Association: crosstabs, chi-square tests and screens, 2x2 odds/risk
ratios, correlation matrices and screens, the sample-size alpha rule
(survey D13-D17, H1, H4-H6).

Every statistic starts from one partial aggregate over the data
(``groupBy(a, b).count()`` or one ``corr`` per column pair); everything
after that works on the small aggregated table.  Zero cells of a
contingency table (which has a row for every pair of levels by definition)
come from ``explode`` of the observed column levels; the tests need none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabmill.functions.pvalues import chi2_sf, normal_two_sided
from tabmill.session import cut_lineage

Z975 = 1.959963984540054


def alpha_by_n(n: Column, floor: float = 1e-4) -> Column:
    """H1: line through (100, 0.001) and (1000, 0.0003), clamped at ``floor``
    (the raw line turns negative above n = 1,385)."""
    # fixed values of the rule: two anchor points
    n1, a1, n2, a2 = 100.0, 0.001, 1000.0, 0.0003
    slope = (a2 - a1) / (n2 - n1)
    return F.greatest(F.lit(slope) * (n.cast("double") - n1) + a1, F.lit(floor))


def _counts(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    obs = F.sum(F.col(weight)).cast("long") if weight else F.count(F.lit(1))
    return df.groupBy(*keys, a, b).agg(obs.alias("observed"))


def contingency(df: DataFrame, a: str, b: str, keys: Sequence[str] = (),
                weight: str | None = None) -> DataFrame:
    """D13 long form with zero cells: (keys, a, b, observed, row_total,
    col_total, n, expected).  ``keys`` lets one pass serve many tables
    (the chi-square screen).  ``weight`` names a count column of
    pre-aggregated rows (each row stands for that many)."""
    keys = list(keys)
    # the data pass: one partial aggregate; all later joins are between
    # aggregated tables of (levels_a x levels_b) rows per key
    cnt = _counts(df, a, b, keys, weight)

    rows = cnt.groupBy(*keys, a).agg(F.sum("observed").alias("row_total"))
    cols = cnt.groupBy(*keys, b).agg(F.sum("observed").alias("col_total"))
    tot_aggs = [F.sum("observed").alias("n"), F.countDistinct(a).alias("n_a"), F.countDistinct(b).alias("n_b")]
    if keys:
        b_levels = cnt.groupBy(*keys).agg(F.array_sort(F.collect_set(b)).alias("__bl"))
        grid = cnt.select(*keys, a).distinct().join(b_levels, keys, "inner").select(
            *keys, a, F.explode("__bl").alias(b))
        full = grid.join(cnt, [*keys, a, b], "left").fillna(0, ["observed"])
        full = full.join(rows, [*keys, a]).join(cols, [*keys, b]).join(cnt.groupBy(*keys).agg(*tot_aggs), keys)
    else:
        # one table: its column levels and totals are scalar subqueries (no
        # join on a constant key, which the optimizer would turn into a
        # cartesian product)
        b_levels = cnt.select(F.array_sort(F.collect_set(b))).scalar()
        grid = cnt.select(a).distinct().select(a, F.explode(b_levels).alias(b))
        full = grid.join(cnt, [a, b], "left").fillna(0, ["observed"])
        full = full.join(rows, a).join(cols, b)
        t = cnt.select(F.struct(*tot_aggs).alias("t")).scalar()
        full = full.withColumns({"n": t["n"], "n_a": t["n_a"], "n_b": t["n_b"]})
    return full.withColumn("expected", F.col("row_total") * F.col("col_total") / F.col("n").cast("double"))


def crosstab(df: DataFrame, a: str, b: str, normalize: str | None = None,
             weight: str | None = None) -> DataFrame:
    """Counts, or shares over all / row (index) / column."""
    full = contingency(df, a, b, weight=weight)
    out = full.select(a, b, F.col("observed").alias("n"),
                      F.col("row_total"), F.col("col_total"), F.col("n").alias("__n"))
    if normalize is None:
        return out.select(a, b, "n")
    den = {"all": "__n", "index": "row_total", "columns": "col_total"}[normalize]
    return out.select(a, b, (F.col("n") / F.col(den).cast("double")).alias("share"))


def _yates(observed: Column, expected: Column) -> Column:
    """|O - E| less the continuity correction."""
    diff = F.abs(observed - expected)
    return diff - F.least(F.lit(0.5), diff)


def chi2_test(df: DataFrame, a: str, b: str, yates: bool = True, keys: Sequence[str] = (),
              weight: str | None = None) -> DataFrame:
    """H4: Pearson chi-square of the a x b table: statistic, dof, p, n.
    Yates' correction applies when dof = 1 (SciPy's default).

    Only the cells that occur are needed: the statistic is n (sum O^2 / (R
    C) - 1), and in a 2x2 table |O - E| is the same in all four cells.  The
    counts are written once; no table of all level pairs is built, so any
    number of levels works.
    """
    keys = list(keys)
    one = keys or ["__one"]
    cnt = _counts(df, a, b, keys, weight)
    cnt = cut_lineage(cnt if keys else cnt.withColumn("__one", F.lit(1)))
    rows = cnt.groupBy(*one, a).agg(F.sum("observed").alias("__r"))
    cols = cnt.groupBy(*one, b).agg(F.sum("observed").alias("__c"))
    n_rows = rows.groupBy(*one).agg(F.count(F.lit(1)).alias("n_a"), F.sum("__r").alias("n"), F.sum(1 / F.col("__r")).alias("__ir"))
    n_cols = cols.groupBy(*one).agg(F.count(F.lit(1)).alias("n_b"), F.sum(1 / F.col("__c")).alias("__ic"))
    o, r, c = (F.col(x).cast("double") for x in ("observed", "__r", "__c"))
    # the per-table totals are one row per key: a key's cells are summed up before they meet them
    cells = cnt.join(rows, [*one, a]).join(cols, [*one, b]).groupBy(*one).agg(
        F.sum(o / r * (o / c)).alias("__s"), F.max(F.struct(o.alias("o"), (r * c).alias("rc"))).alias("__cell"))
    t = cells.join(n_rows, one).join(n_cols, one)
    n, dof = F.col("n").cast("double"), (F.col("n_a") - 1) * (F.col("n_b") - 1)
    corrected = F.pow(_yates(F.col("__cell.o"), F.col("__cell.rc") / n), 2) * n * F.col("__ir") * F.col("__ic")
    plain = n * (F.col("__s") - 1)
    stat = F.when(dof == 1, corrected).otherwise(plain) if yates else plain
    res = t.select(*keys, F.greatest(stat, F.lit(0.0)).alias("statistic"), dof.alias("dof"), "n")
    return res.withColumn("p_value", chi2_sf(F.col("statistic"), F.col("dof")))


def chi2_from_table(full: DataFrame, yates: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """H4 on an already built ``contingency`` table (reuse it for both the
    table and the test)."""
    o, e = F.col("observed").cast("double"), F.col("expected")
    dof = (F.col("n_a") - 1) * (F.col("n_b") - 1)
    term = F.when(dof == 1, F.pow(_yates(o, e), 2) / e).otherwise(F.pow(o - e, 2) / e) if yates else F.pow(o - e, 2) / e
    agg = full.groupBy(*keys).agg(F.sum(term).alias("statistic"), F.first(dof).alias("dof"), F.first("n").alias("n"))
    return agg.withColumn("p_value", chi2_sf(F.col("statistic"), F.col("dof")))


def chi2_screen(df: DataFrame, cats: Sequence[str], y: str, alpha: Column | float,
                yates: bool = True) -> DataFrame:
    """H5: every categorical against the target in one aggregate over the
    unpivoted (variable, level, y) table; keep = p <= alpha."""
    long = df.select(y, *[F.col(c).cast("string").alias(c) for c in cats]).unpivot(
        [y], list(cats), "variable", "level")
    res = chi2_test(long, "level", y, yates, keys=["variable"])
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return res.withColumn("keep", (F.col("p_value") <= a).cast("int"))


def table2x2(df: DataFrame, exposure: str, outcome: str) -> DataFrame:
    """H6: odds ratio, risk ratio, their logs, standard errors, 95% limits
    and Wald p-values of a 0/1 x 0/1 table.  Rows: exposure 0/1; columns:
    outcome 0/1; [[a, b], [c, d]].  Any zero cell adds 0.5 to all four."""
    e, o = F.col(exposure), F.col(outcome)
    t = df.agg(F.count_if((e == 0) & (o == 0)).alias("a"), F.count_if((e == 0) & (o == 1)).alias("b"),
               F.count_if((e == 1) & (o == 0)).alias("c"), F.count_if((e == 1) & (o == 1)).alias("d"))
    zero = (F.col("a") == 0) | (F.col("b") == 0) | (F.col("c") == 0) | (F.col("d") == 0)
    t = t.withColumns({k: F.col(k).cast("double") + F.when(zero, F.lit(0.5)).otherwise(F.lit(0.0))
                       for k in "abcd"})
    a, b, c, d = (F.col(k) for k in "abcd")
    log_or = F.log(a * d / (b * c))
    se_or = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    log_rr = F.log((d / (c + d)) / (b / (a + b)))
    se_rr = F.sqrt(1 / d - 1 / (c + d) + 1 / b - 1 / (a + b))
    return t.select(
        *[F.col(k).alias(f"cell_{k}") for k in "abcd"],
        F.exp(log_or).alias("odds_ratio"), log_or.alias("log_odds_ratio"), se_or.alias("se_log_or"),
        F.exp(log_or - Z975 * se_or).alias("or_ci_low"), F.exp(log_or + Z975 * se_or).alias("or_ci_high"),
        normal_two_sided(log_or / se_or).alias("or_p_value"),
        F.exp(log_rr).alias("risk_ratio"), log_rr.alias("log_risk_ratio"), se_rr.alias("se_log_rr"),
        F.exp(log_rr - Z975 * se_rr).alias("rr_ci_low"), F.exp(log_rr + Z975 * se_rr).alias("rr_ci_high"),
        normal_two_sided(log_rr / se_rr).alias("rr_p_value"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair in one aggregate (c(c-1)/2
    ``corr`` states), returned long (var_a, var_b, i, j, r), both triangles
    and the diagonal."""
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    wide = df.agg(*[F.corr(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")).alias(f"c{i}_{j}")
                    for i, j in pairs])
    entries = []
    for i, j in pairs:
        for x, y in ((i, j), (j, i)):
            entries.append(F.struct(F.lit(cols[x]).alias("var_a"), F.lit(cols[y]).alias("var_b"),
                                    F.lit(x).alias("i"), F.lit(y).alias("j"), F.col(f"c{i}_{j}").alias("r")))
    for i in range(len(cols)):
        entries.append(F.struct(F.lit(cols[i]).alias("var_a"), F.lit(cols[i]).alias("var_b"),
                                F.lit(i).alias("i"), F.lit(i).alias("j"), F.lit(1.0).alias("r")))
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def corr_lower(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lower triangle only (row index > column index)."""
    return corr_matrix(df, cols).where(F.col("i") > F.col("j"))


def strong_pairs(df: DataFrame, cols: Sequence[str], lo: float = 0.6, hi: float = 1.0) -> DataFrame:
    """Pairs with lo < |r| < hi (the diagonal falls out by hi = 1)."""
    return corr_matrix(df, cols).where((F.abs("r") > lo) & (F.abs("r") < hi))
