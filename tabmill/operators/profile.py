"""Profiling: counts, missing cells, descriptive statistics, bins, histograms,
box-plot numbers (survey D1-D12, D22, D24, H9, H12, H15, I1-I3).

All statistics of many columns are computed in one aggregate (or one pass
over an unpivoted long table), with partial aggregation before the shuffle,
so a hot value never concentrates in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabmill.operators.ordering import exact_quantiles

SENTINEL = -9


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per value (display order: count desc)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values occurring more than once, with their count."""
    return value_counts(df, key).where(F.col("n") != 1)


def missing_count_expr(cols: Sequence[str], sentinel=SENTINEL) -> Column:
    return sum((F.col(c) == sentinel).cast("int") for c in cols)


def row_missing_share(df: DataFrame, id_col: str, cols: Sequence[str] | None = None,
                      sentinel=SENTINEL) -> DataFrame:
    """Missing cells per row as a share of all non-id columns; only rows
    with at least one missing cell."""
    cols = [c for c in (cols or df.columns) if c != id_col]
    n = missing_count_expr(cols, sentinel)
    return (df.select(id_col, n.alias("n_missing"))
            .where(F.col("n_missing") > 0)
            .withColumn("share", F.col("n_missing") / F.lit(float(len(cols)))))


def drop_sparse_rows(df: DataFrame, id_col: str, threshold: float = 0.10,
                     cols: Sequence[str] | None = None, sentinel=SENTINEL) -> DataFrame:
    """Drop rows whose missing share exceeds ``threshold`` (row-local
    filter: no join back by index)."""
    cols = [c for c in (cols or df.columns) if c != id_col]
    share = missing_count_expr(cols, sentinel) / F.lit(float(len(cols)))
    return df.where(share <= threshold)


def column_missing_profile(df: DataFrame, cols: Sequence[str] | None = None,
                           sentinel=SENTINEL) -> DataFrame:
    """Missing cells per column, only columns that have any (one pass)."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c) == sentinel).alias(c) for c in cols])
    long = wide.unpivot([], cols, "variable", "n_missing")
    return long.where(F.col("n_missing") > 0)


def complete_columns(df: DataFrame, exclude: Sequence[str] = (), cols: Sequence[str] | None = None,
                     sentinel=SENTINEL) -> DataFrame:
    """Predictor candidates = columns with no missing cell, minus ``exclude``."""
    cols = [c for c in (cols or df.columns) if c not in set(exclude)]
    wide = df.agg(*[F.count_if(F.col(c) == sentinel).alias(c) for c in cols])
    return wide.unpivot([], cols, "variable", "n_missing").where(F.col("n_missing") == 0).select("variable")


def sentinel_to_null(df: DataFrame, cols: Sequence[str], sentinel=SENTINEL) -> DataFrame:
    """Sentinel -> NULL at the cleaning boundary."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in cols})


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(by), list(cols), "variable", "value")


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, std (n-1), min, 25/50/75% (linear), max per column
    (and per group).  Moments in one partial aggregate; quantiles exact
    through a range sort (never a whole group in one buffer)."""
    long = _long(df, cols, by)
    key = [*by, "variable"]
    moments = long.groupBy(*key).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = exact_quantiles(long, key, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return moments.join(q, key, "left")


def group_mean(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Mean per group."""
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in cols])


def mode_of(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Mode, smallest value among ties (pandas ``mode()[0]``).

    Value counts by partial aggregate, then ``min_by`` over (-count, value):
    also a partial aggregate, so neither step gathers a group in one task.
    """
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("__n"))
    key = F.struct((-F.col("__n")).alias("a"), F.col(col).alias("b"))
    if by:
        return counts.groupBy(*by).agg(F.min_by(F.col(col), key).alias("mode"))
    return counts.agg(F.min_by(F.col(col), key).alias("mode"))


def subgroup_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    """Count, mean, std, median and mode of ``col`` per subgroup,
    one grouped pass instead of one filtered pass per subgroup."""
    mom = df.groupBy(by).agg(F.count(col).alias("count"), F.avg(col).alias("mean"),
                             F.stddev_samp(col).alias("std"))
    med = exact_quantiles(df.select(by, col), [by], col, {"median": 0.5})
    mode = mode_of(df, col, [by])
    return mom.join(med, by, "left").join(mode, by, "left")


def sigma_bands(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Mean -/+ k * std (n-1), rounded to 2."""
    long = _long(df, cols)
    st = long.groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    st = st.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    return st.select("variable", "k",
                     F.round(F.col("mean") - F.col("k") * F.col("std"), 2).alias("lower"),
                     F.round(F.col("mean") + F.col("k") * F.col("std"), 2).alias("upper"))


def rowwise(df: DataFrame, cols: Sequence[str], sum_name: str = "row_sum",
            min_name: str = "row_min", mean_name: str | None = None) -> DataFrame:
    """Row-wise sum, min (and mean) over named columns."""
    out = {sum_name: sum(F.col(c) for c in cols), min_name: F.least(*[F.col(c) for c in cols])}
    if mean_name:
        out[mean_name] = sum(F.col(c) for c in cols) / F.lit(float(len(cols)))
    return df.withColumns(out)


def equal_width_bins(df: DataFrame, col: str, bins: int, name: str | None = None) -> DataFrame:
    """H9: equal-width, right-closed bins over [min, max] with the lowest
    edge widened (labels '0'..'bins-1').  x in (e_i, e_i+1] -> i, i.e.
    ceil((x - min) / w) - 1, the minimum itself in bin 0.  min/max are
    scalar subqueries (one global aggregate)."""
    lo = df.select(F.min(col).cast("double")).scalar()
    hi = df.select(F.max(col).cast("double")).scalar()
    w = (hi - lo) / F.lit(float(bins))
    b = F.greatest(F.ceil((F.col(col).cast("double") - lo) / w) - 1, F.lit(0))
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(b, F.lit(bins - 1)))
    return df.withColumn(name or f"{col}_binned", b.cast("int").cast("string"))


def histogram(df: DataFrame, col: str, by: str, bins: int = 10) -> DataFrame:
    """Per class, ``bins`` equal bins over that class's own range, the
    last bin closed; empty bins reported with count 0."""
    x = F.col(col).cast("double")
    rng = df.groupBy(by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    counted = (df.select(by, x.alias("__x")).join(rng, by, "inner")
               .withColumn("bin", F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
                   F.least(F.floor((F.col("__x") - F.col("lo")) / w), F.lit(bins - 1))).cast("int"))
               .groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n")))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    grid = grid.withColumns({"left_edge": F.col("lo") + F.col("bin") * w,
                             "right_edge": F.col("lo") + (F.col("bin") + 1) * w})
    out = grid.join(counted, [by, "bin"], "left").fillna(0, ["n"])
    return out.select(by, "bin", "left_edge", "right_edge", "n")


def box_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    """Quartiles, IQR, 1.5 IQR whisker ends (the most extreme data
    inside the fences) and the number of outliers, per group."""
    x = F.col(col).cast("double")
    q = exact_quantiles(df.select(by, x.alias("__x")), [by], "__x",
                        {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    j = df.select(by, x.alias("__x")).join(q, by, "inner")
    w = j.groupBy(by).agg(
        F.min(F.when(F.col("__x") >= lo_f, F.col("__x"))).alias("whisker_low"),
        F.max(F.when(F.col("__x") <= hi_f, F.col("__x"))).alias("whisker_high"),
        F.count_if((F.col("__x") < lo_f) | (F.col("__x") > hi_f)).alias("n_outliers"))
    return q.join(w, by, "inner")
