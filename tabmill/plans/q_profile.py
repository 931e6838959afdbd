"""Profiling and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabmill.operators import profile
from tabmill.plans.inputs import STUDY_MISSING_SQL, STUDY_SQL, study, study_missing
from tabmill.plans.registry import query
from tabmill.sources.tables import table

R = 6


def _r(c, d=R):
    return F.round(c, d)


@query("value_counts", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def value_counts(spark, sf):
    return profile.value_counts(table(spark, sf, "events"), "user_id")


@query("duplicate_keys", """SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey
HAVING count(*) <> 1""")
def duplicate_keys(spark, sf):
    return profile.duplicate_keys(table(spark, sf, "orders"), "o_custkey")


_MISS_COLS = ["acctbal", "n_orders", "avg_price", "max_price", "share_f", "seg", "nation", "region", "big",
              "label"]
_MISS_SUM = " + ".join(f"CAST({c} = -9 AS INTEGER)" for c in _MISS_COLS)


@query("row_missing_share", f"""WITH {STUDY_MISSING_SQL}
SELECT id, n_missing, round(n_missing / 10.0, 6) AS share
FROM (SELECT id, {_MISS_SUM} AS n_missing FROM study_missing) WHERE n_missing > 0""")
def row_missing_share(spark, sf):
    out = profile.row_missing_share(study_missing(spark, sf), "id")
    return out.select("id", F.col("n_missing"), _r(F.col("share")).alias("share"))


@query("column_missing_profile", f"""WITH {STUDY_MISSING_SQL},
u AS (UNPIVOT (SELECT {", ".join(f"count_if({c} = -9) AS {c}" for c in _MISS_COLS)} FROM study_missing)
      ON {", ".join(_MISS_COLS)} INTO NAME variable VALUE n_missing)
SELECT variable, n_missing FROM u WHERE n_missing > 0""")
def column_missing_profile(spark, sf):
    return profile.column_missing_profile(study_missing(spark, sf).drop("id"))


@query("drop_sparse_rows", f"""WITH {STUDY_MISSING_SQL}
SELECT * FROM study_missing WHERE ({_MISS_SUM}) / 10.0 <= 0.10""")
def drop_sparse_rows(spark, sf):
    return profile.drop_sparse_rows(study_missing(spark, sf), "id", 0.10)


@query("complete_columns", f"""WITH {STUDY_MISSING_SQL},
kept AS (SELECT * FROM study_missing WHERE ({_MISS_SUM}) / 10.0 <= 0.10),
u AS (UNPIVOT (SELECT {", ".join(f"count_if({c} = -9) AS {c}" for c in _MISS_COLS if c != 'label')} FROM kept)
      ON {", ".join(c for c in _MISS_COLS if c != 'label')} INTO NAME variable VALUE n_missing)
SELECT variable FROM u WHERE n_missing = 0""")
def complete_columns(spark, sf):
    kept = profile.drop_sparse_rows(study_missing(spark, sf), "id", 0.10)
    return profile.complete_columns(kept, exclude=["id", "label"])


@query("sentinel_to_null", f"""WITH {STUDY_MISSING_SQL}
SELECT id, nullif(avg_price, -9) AS avg_price, nullif(seg, -9) AS seg FROM study_missing""")
def sentinel_to_null(spark, sf):
    out = profile.sentinel_to_null(study_missing(spark, sf), ["avg_price", "seg"])
    return out.select("id", "avg_price", "seg")


LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(src_cte: str, src: str, cols, by: str | None = None) -> str:
    byc = f"{by}, " if by else ""
    parts = []
    for c in cols:
        parts.append(f"""SELECT {byc}'{c}' AS variable, count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
  round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max
FROM {src} {'GROUP BY ' + by if by else ''}""")
    return (f"WITH {src_cte} " if src_cte else "") + "\nUNION ALL ".join(parts)


def _describe_out(df):
    return df.select(*[c for c in df.columns if c not in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")],
                     "count", *[_r(F.col(c)).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query("describe_numeric", _describe_sql("", "lineitem", LI_COLS))
def describe_numeric(spark, sf):
    return _describe_out(profile.describe(table(spark, sf, "lineitem"), LI_COLS))


@query("describe_by_group", _describe_sql("", "orders", ["o_totalprice"], "o_orderstatus"))
def describe_by_group(spark, sf):
    return _describe_out(profile.describe(table(spark, sf, "orders"), ["o_totalprice"], by=["o_orderstatus"]))


@query("group_mean", f"""WITH {STUDY_SQL}
SELECT seg, round(avg(acctbal), 6) AS acctbal, round(avg(avg_price), 6) AS avg_price,
       round(avg(n_orders), 6) AS n_orders FROM study GROUP BY seg""")
def group_mean(spark, sf):
    out = profile.group_mean(study(spark, sf), "seg", ["acctbal", "avg_price", "n_orders"])
    return out.select("seg", *[_r(F.col(c)).alias(c) for c in ("acctbal", "avg_price", "n_orders")])


_MODE_COLS = ["l_quantity", "l_discount", "l_tax"]


@query("mode_stat", "\nUNION ALL ".join(f"""SELECT '{c}' AS variable,
  (SELECT {c} FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1) AS mode,
  (SELECT round(median({c}), 6) FROM lineitem) AS median""" for c in _MODE_COLS))
def mode_stat(spark, sf):
    """Mode (smallest among ties) and median of three columns."""
    li = table(spark, sf, "lineitem")
    long = li.select(*_MODE_COLS).unpivot([], _MODE_COLS, "variable", "value")
    mode = profile.mode_of(long, "value", ["variable"])
    from tabmill.operators.ordering import exact_quantiles
    med = exact_quantiles(long, ["variable"], "value", {"median": 0.5})
    return mode.join(med, "variable").select("variable", "mode", _r(F.col("median")).alias("median"))


@query("subgroup_stats", f"""WITH {STUDY_SQL},
m AS (SELECT label, count(n_orders) AS count, round(avg(n_orders), 6) AS mean,
             round(stddev_samp(n_orders), 6) AS std, round(median(n_orders), 6) AS median FROM study GROUP BY label),
mo AS (SELECT label, n_orders AS mode FROM (SELECT label, n_orders, count(*) AS c FROM study GROUP BY ALL)
       QUALIFY row_number() OVER (PARTITION BY label ORDER BY c DESC, n_orders) = 1)
SELECT m.*, mo.mode FROM m JOIN mo USING (label)""")
def subgroup_stats(spark, sf):
    out = profile.subgroup_stats(study(spark, sf), "n_orders", "label")
    return out.select("label", "count", *[_r(F.col(c)).alias(c) for c in ("mean", "std", "median")], "mode")


@query("sigma_bands", f"""WITH {STUDY_SQL},
s AS (SELECT 'acctbal' AS variable, avg(acctbal) AS m, stddev_samp(acctbal) AS sd FROM study
      UNION ALL SELECT 'avg_price', avg(avg_price), stddev_samp(avg_price) FROM study)
SELECT variable, k, round(m - k * sd, 2) AS lower, round(m + k * sd, 2) AS upper
FROM s CROSS JOIN (VALUES (1), (2), (3)) t(k)""")
def sigma_bands(spark, sf):
    return profile.sigma_bands(study(spark, sf), ["acctbal", "avg_price"])


@query("rowwise_sum_min", """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax,
  round(l_quantity + l_discount + l_tax, 6) AS row_sum, least(l_quantity, l_discount, l_tax) AS row_min,
  round((l_quantity + l_discount + l_tax) / 3.0, 6) AS row_mean FROM lineitem""")
def rowwise_sum_min(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    out = profile.rowwise(li, ["l_quantity", "l_discount", "l_tax"], mean_name="row_mean")
    return out.withColumns({"row_sum": _r(F.col("row_sum")), "row_mean": _r(F.col("row_mean"))})


@query("equal_width_bins", """WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
SELECT c_custkey, c_acctbal, CAST(CASE WHEN hi = lo THEN 0 ELSE
  least(greatest(ceil((c_acctbal - lo) / ((hi - lo) / 5.0)) - 1, 0), 4) END AS INTEGER)::VARCHAR AS c_acctbal_binned
FROM customer CROSS JOIN s""")
def equal_width_bins(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return profile.equal_width_bins(c, "c_acctbal", 5)


@query("histogram_by_class", f"""WITH {STUDY_SQL},
r AS (SELECT label, min(avg_price) AS lo, max(avg_price) AS hi FROM study GROUP BY label),
c AS (SELECT s.label, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((avg_price - lo) / ((hi - lo) / 10.0)), 9) END AS INTEGER) AS bin,
             count(*) AS n FROM study s JOIN r USING (label) GROUP BY ALL),
g AS (SELECT label, lo, hi, unnest(range(0, 10)) AS bin FROM r)
SELECT g.label, CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * ((hi - lo) / 10.0), 6) AS left_edge,
       round(lo + (g.bin + 1) * ((hi - lo) / 10.0), 6) AS right_edge, coalesce(c.n, 0) AS n
FROM g LEFT JOIN c ON c.label = g.label AND c.bin = g.bin""")
def histogram_by_class(spark, sf):
    out = profile.histogram(study(spark, sf), "avg_price", "label", 10)
    return out.withColumns({"left_edge": _r(F.col("left_edge")), "right_edge": _r(F.col("right_edge"))})


@query("box_stats", """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1,
        quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.o_orderpriority, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       round(min(CASE WHEN o_totalprice >= lo THEN o_totalprice END), 6) AS whisker_low,
       round(max(CASE WHEN o_totalprice <= hi THEN o_totalprice END), 6) AS whisker_high,
       count_if(o_totalprice < lo OR o_totalprice > hi) AS n_outliers
FROM orders o JOIN f USING (o_orderpriority) GROUP BY f.o_orderpriority, q1, median, q3, iqr""")
def box_stats(spark, sf):
    out = profile.box_stats(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return out.select("o_orderpriority", *[_r(F.col(c)).alias(c) for c in
                                           ("q1", "median", "q3", "iqr", "whisker_low", "whisker_high")],
                      "n_outliers")
