"""Association queries: crosstabs, chi-square, odds/risk ratios, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabmill.functions.pvalues import chi2_sf_sql, normal_two_sided_sql
from tabmill.operators import assoc
from tabmill.plans.inputs import STUDY_SQL, URGENT, study, urgent
from tabmill.plans.registry import query
from tabmill.session import cut_lineage
from tabmill.sources.tables import table

R = 6  # digits kept on floating outputs (engines sum in different orders)


def _r(c, d=R):
    return F.round(c, d)


def orders_segment(spark: SparkSession, sf: str) -> DataFrame:
    """(c_mktsegment, o_orderpriority, urgent, n) - orders pre-aggregated per
    customer before the customer join (the join then sees one row per
    customer and priority instead of one per order)."""
    o = (table(spark, sf, "orders")
         .groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return j.select("c_mktsegment", "o_orderpriority", urgent().alias("urgent"), "n")


# ---- flagship: is market segment associated with urgent orders? ---------------------

def segment_urgency(spark: SparkSession, sf: str) -> DataFrame:
    """Crosstab segment x urgent (counts, row shares, expected) with the
    chi-square test, its p-value and the decision against alpha(n)."""
    rows = orders_segment(spark, sf)
    # the contingency table is tiny (levels x levels): materialise it once and
    # derive both the table and the test from it
    full = cut_lineage(assoc.contingency(rows, "c_mktsegment", "urgent", weight="n"))
    test = assoc.chi2_from_table(full)
    t = test.select(F.struct("statistic", "dof", "p_value", "n").alias("t")).scalar()
    alpha = assoc.alpha_by_n(t["n"])
    return full.select(
        "c_mktsegment", "urgent", "observed",
        _r(F.col("expected")).alias("expected"),
        _r(F.col("observed") / F.col("row_total")).alias("row_share"),
        _r(t["statistic"]).alias("statistic"), t["dof"].cast("long").alias("dof"),
        _r(t["p_value"], 8).alias("p_value"), _r(alpha, 8).alias("alpha"),
        (t["p_value"] <= alpha).cast("int").alias("reject"))


_OC = f"""oc AS (
  SELECT c.c_mktsegment, o.o_orderpriority,
         CASE WHEN o.o_orderpriority IN ('{URGENT[0]}', '{URGENT[1]}') THEN 1 ELSE 0 END AS urgent
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def _full_sql(src: str, a: str, b: str, sfx: str = "") -> str:
    return f"""cnt{sfx} AS (SELECT {a}, {b}, count(*) AS observed FROM {src} GROUP BY {a}, {b}),
grid{sfx} AS (SELECT x.{a}, y.{b} FROM (SELECT DISTINCT {a} FROM cnt{sfx}) x
              CROSS JOIN (SELECT DISTINCT {b} FROM cnt{sfx}) y),
rt{sfx} AS (SELECT {a}, sum(observed) AS row_total FROM cnt{sfx} GROUP BY {a}),
ct{sfx} AS (SELECT {b}, sum(observed) AS col_total FROM cnt{sfx} GROUP BY {b}),
tt{sfx} AS (SELECT sum(observed) AS n, count(DISTINCT {a}) AS n_a, count(DISTINCT {b}) AS n_b FROM cnt{sfx}),
fullt{sfx} AS (SELECT g.{a}, g.{b}, coalesce(c.observed, 0) AS observed, rt.row_total, ct.col_total, tt.n,
                tt.n_a, tt.n_b, rt.row_total * ct.col_total / tt.n::DOUBLE AS expected
         FROM grid{sfx} g LEFT JOIN cnt{sfx} c ON c.{a} = g.{a} AND c.{b} = g.{b}
         JOIN rt{sfx} rt ON rt.{a} = g.{a} JOIN ct{sfx} ct ON ct.{b} = g.{b} CROSS JOIN tt{sfx} tt)"""


def _chi2_sql(full: str = "fullt", keys: str = "") -> str:
    kp = f"{keys}, " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {kp}sum(CASE WHEN (n_a - 1) * (n_b - 1) = 1
                THEN power(abs(observed - expected) - least(0.5, abs(observed - expected)), 2) / expected
                ELSE power(observed - expected, 2) / expected END) AS statistic,
       max((n_a - 1) * (n_b - 1)) AS dof, max(n) AS n
FROM {full} {grp}"""


SEGMENT_URGENCY_SQL = f"""WITH {_OC}, {_full_sql('oc', 'c_mktsegment', 'urgent')},
t AS ({_chi2_sql()}),
tp AS (SELECT *, {chi2_sf_sql('statistic', 'dof')} AS p_value,
              greatest((0.0003 - 0.001) / (1000.0 - 100.0) * (n - 100.0) + 0.001, 0.0001) AS alpha FROM t)
SELECT f.c_mktsegment, f.urgent, f.observed, round(f.expected, 6) AS expected,
       round(f.observed / f.row_total::DOUBLE, 6) AS row_share, round(tp.statistic, 6) AS statistic,
       CAST(tp.dof AS BIGINT) AS dof, round(tp.p_value, 8) AS p_value, round(tp.alpha, 8) AS alpha,
       CAST(tp.p_value <= tp.alpha AS INTEGER) AS reject
FROM fullt f CROSS JOIN tp"""

query("segment_urgency", SEGMENT_URGENCY_SQL)(segment_urgency)


# ---- crosstabs ---------------------------------------------------------------------------

def _crosstab_q(normalize):
    def q(spark, sf):
        rows = orders_segment(spark, sf)
        out = assoc.crosstab(rows, "c_mktsegment", "o_orderpriority", normalize, weight="n")
        return out.withColumn("share", _r(F.col("share"))) if normalize else out
    return q


def _crosstab_sql(normalize):
    if normalize is None:
        sel = "observed AS n"
    else:
        den = {"all": "n", "index": "row_total", "columns": "col_total"}[normalize]
        sel = f"round(observed / {den}::DOUBLE, 6) AS share"
    return f"""WITH {_OC}, {_full_sql('oc', 'c_mktsegment', 'o_orderpriority')}
SELECT c_mktsegment, o_orderpriority, {sel} FROM fullt"""


query("crosstab_counts", _crosstab_sql(None))(_crosstab_q(None))
query("crosstab_all", _crosstab_sql("all"))(_crosstab_q("all"))
query("crosstab_index", _crosstab_sql("index"))(_crosstab_q("index"))
query("crosstab_columns", _crosstab_sql("columns"))(_crosstab_q("columns"))


# ---- chi-square ------------------------------------------------------------------------------

def _returned_status(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("returned"),
                     (F.col("l_linestatus") == "F").cast("int").alias("finished"))


@query("chi2_contingency", f"""WITH {_OC}, {_full_sql('oc', 'c_mktsegment', 'urgent')},
li AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS returned, CAST(l_linestatus = 'F' AS INTEGER) AS finished
       FROM lineitem),
{_full_sql('li', 'returned', 'finished', '2')},
t AS (SELECT 'segment_x_urgent' AS test, * FROM ({_chi2_sql('fullt')})
      UNION ALL SELECT 'returned_x_finished', * FROM ({_chi2_sql('fullt2')}))
SELECT test, round(statistic, 6) AS statistic, CAST(dof AS BIGINT) AS dof, CAST(n AS BIGINT) AS n,
       round({chi2_sf_sql('statistic', 'dof')}, 8) AS p_value FROM t""")
def chi2_contingency(spark, sf):
    """H4 on a 5x2 table (no correction) and a 2x2 table (Yates)."""
    rows = orders_segment(spark, sf)
    a = assoc.chi2_test(rows, "c_mktsegment", "urgent", weight="n").withColumn("test", F.lit("segment_x_urgent"))
    b = assoc.chi2_test(_returned_status(spark, sf), "returned", "finished").withColumn(
        "test", F.lit("returned_x_finished"))
    return a.unionByName(b).select("test", _r(F.col("statistic")).alias("statistic"),
                                   F.col("dof").cast("long").alias("dof"), F.col("n").cast("long").alias("n"),
                                   _r(F.col("p_value"), 8).alias("p_value"))


@query("chi2_expected", f"""WITH {_OC}, {_full_sql('oc', 'c_mktsegment', 'o_orderpriority')}
SELECT c_mktsegment, o_orderpriority, observed, round(expected, 6) AS expected FROM fullt""")
def chi2_expected(spark, sf):
    rows = orders_segment(spark, sf)
    full = assoc.contingency(rows, "c_mktsegment", "o_orderpriority", weight="n")
    return full.select("c_mktsegment", "o_orderpriority", "observed", _r(F.col("expected")).alias("expected"))


@query("chi2_parts", f"""WITH {_full_sql('lineitem', 'l_partkey', 'l_returnflag')},
t AS ({_chi2_sql()})
SELECT round(statistic, 4) AS statistic, CAST(dof AS BIGINT) AS dof, CAST(n AS BIGINT) AS n,
       round({chi2_sf_sql('statistic', 'dof')}, 8) AS p_value FROM t""")
def chi2_parts(spark, sf):
    """H4 with thousands of degrees of freedom: parts against return flags."""
    t = assoc.chi2_test(table(spark, sf, "lineitem").select("l_partkey", "l_returnflag"), "l_partkey", "l_returnflag")
    return t.select(_r(F.col("statistic"), 4).alias("statistic"), F.col("dof").cast("long").alias("dof"),
                    F.col("n").cast("long").alias("n"), _r(F.col("p_value"), 8).alias("p_value"))


SCREEN_CATS = ["seg", "nation", "region", "big"]


@query("chi2_screen", f"""WITH {STUDY_SQL},
long AS (UNPIVOT (SELECT label, CAST(seg AS VARCHAR) AS seg, CAST(nation AS VARCHAR) AS nation,
                         CAST(region AS VARCHAR) AS region, CAST(big AS VARCHAR) AS big FROM study)
         ON seg, nation, region, big INTO NAME variable VALUE level),
cnt AS (SELECT variable, level, label, count(*) AS observed FROM long GROUP BY ALL),
grid AS (SELECT a.variable, a.level, b.label FROM (SELECT DISTINCT variable, level FROM cnt) a
         JOIN (SELECT DISTINCT variable, label FROM cnt) b ON a.variable = b.variable),
rt AS (SELECT variable, level, sum(observed) AS row_total FROM cnt GROUP BY ALL),
ct AS (SELECT variable, label, sum(observed) AS col_total FROM cnt GROUP BY ALL),
tt AS (SELECT variable, sum(observed) AS n, count(DISTINCT level) AS n_a, count(DISTINCT label) AS n_b
       FROM cnt GROUP BY ALL),
fullt AS (SELECT g.variable, coalesce(c.observed, 0) AS observed, tt.n, tt.n_a, tt.n_b,
                rt.row_total * ct.col_total / tt.n::DOUBLE AS expected
         FROM grid g LEFT JOIN cnt c ON c.variable = g.variable AND c.level = g.level AND c.label = g.label
         JOIN rt ON rt.variable = g.variable AND rt.level = g.level
         JOIN ct ON ct.variable = g.variable AND ct.label = g.label JOIN tt ON tt.variable = g.variable),
t AS ({_chi2_sql('fullt', 'variable')}),
tp AS (SELECT *, {chi2_sf_sql('statistic', 'dof')} AS p_value,
              greatest((0.0003 - 0.001) / (1000.0 - 100.0) * (n - 100.0) + 0.001, 0.0001) AS alpha FROM t)
SELECT variable, round(statistic, 6) AS statistic, CAST(dof AS BIGINT) AS dof, round(p_value, 8) AS p_value,
       round(alpha, 8) AS alpha, CAST(p_value <= alpha AS INTEGER) AS keep FROM tp""")
def chi2_screen(spark, sf):
    """H5: the study's categoricals against the label, alpha from n."""
    s = study(spark, sf)
    n = s.select(F.count(F.lit(1))).scalar()
    alpha = assoc.alpha_by_n(n)
    res = assoc.chi2_screen(s, SCREEN_CATS, "label", alpha)
    return res.select("variable", _r(F.col("statistic")).alias("statistic"), F.col("dof").cast("long").alias("dof"),
                      _r(F.col("p_value"), 8).alias("p_value"), _r(alpha, 8).alias("alpha"), "keep")


@query("odds_risk_ratio", f"""WITH {STUDY_SQL},
c AS (SELECT count_if(big = 0 AND label = 0) AS a, count_if(big = 0 AND label = 1) AS b,
             count_if(big = 1 AND label = 0) AS c, count_if(big = 1 AND label = 1) AS d FROM study),
z AS (SELECT CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5 ELSE 0.0 END AS e, * FROM c),
v AS (SELECT a + e AS a, b + e AS b, c + e AS c, d + e AS d FROM z),
s AS (SELECT *, ln(a * d / (b * c)) AS lor, sqrt(1/a + 1/b + 1/c + 1/d) AS se_or,
             ln((d / (c + d)) / (b / (a + b))) AS lrr, sqrt(1/d - 1/(c + d) + 1/b - 1/(a + b)) AS se_rr FROM v)
SELECT round(a, 6) AS cell_a, round(b, 6) AS cell_b, round(c, 6) AS cell_c, round(d, 6) AS cell_d,
       round(exp(lor), 6) AS odds_ratio, round(lor, 6) AS log_odds_ratio, round(se_or, 6) AS se_log_or,
       round(exp(lor - 1.959963984540054 * se_or), 6) AS or_ci_low, round(exp(lor + 1.959963984540054 * se_or), 6) AS or_ci_high,
       round({normal_two_sided_sql('lor / se_or')}, 8) AS or_p_value,
       round(exp(lrr), 6) AS risk_ratio, round(lrr, 6) AS log_risk_ratio, round(se_rr, 6) AS se_log_rr,
       round(exp(lrr - 1.959963984540054 * se_rr), 6) AS rr_ci_low, round(exp(lrr + 1.959963984540054 * se_rr), 6) AS rr_ci_high,
       round({normal_two_sided_sql('lrr / se_rr')}, 8) AS rr_p_value FROM s""")
def odds_risk_ratio(spark, sf):
    """H6: high balance (exposure) x label (outcome)."""
    t = assoc.table2x2(study(spark, sf), "big", "label")
    return t.select(*[(_r(F.col(c), 8) if c.endswith("p_value") else _r(F.col(c))).alias(c) for c in t.columns])


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue", "l_linenumber"]


def lineitem_numeric(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
                     F.col("l_linenumber").cast("double").alias("l_linenumber"))


def _corr_sql(where: str) -> str:
    cols = LI_NUM
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols)) if i != j]
    sel = ",\n  ".join(f"corr({cols[min(i, j)]}, {cols[max(i, j)]}) AS c{min(i, j)}_{max(i, j)}"
                       for i, j in pairs if i < j)
    rows = " UNION ALL ".join(
        f"SELECT '{cols[i]}' AS var_a, '{cols[j]}' AS var_b, {i} AS i, {j} AS j, "
        + (f"c{min(i, j)}_{max(i, j)}" if i != j else "1.0::DOUBLE") + " AS r FROM w"
        for i in range(len(cols)) for j in range(len(cols)))
    return f"""WITH li AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax,
                      l_extendedprice * (1 - l_discount) AS revenue, l_linenumber::DOUBLE AS l_linenumber FROM lineitem),
w AS (SELECT {sel} FROM li),
m AS ({rows})
SELECT var_a, var_b, i, j, round(r, 6) AS r FROM m WHERE {where}"""


def _corr_q(fn):
    def q(spark, sf):
        out = fn(lineitem_numeric(spark, sf), LI_NUM)
        return out.select("var_a", "var_b", "i", "j", _r(F.col("r")).alias("r"))
    return q


query("corr_matrix", _corr_sql("TRUE"))(_corr_q(assoc.corr_matrix))
query("corr_lower_triangle", _corr_sql("i > j"))(_corr_q(assoc.corr_lower))
query("corr_strong_pairs", _corr_sql("abs(r) > 0.6 AND abs(r) < 1.0"))(_corr_q(assoc.strong_pairs))


@query("alpha_by_n", """SELECT 'customer' AS tbl, count(*) AS n,
  round(greatest((0.0003 - 0.001) / (1000.0 - 100.0) * (count(*) - 100.0) + 0.001, 0.0001), 10) AS alpha FROM customer
UNION ALL SELECT 'supplier', count(*),
  round(greatest((0.0003 - 0.001) / (1000.0 - 100.0) * (count(*) - 100.0) + 0.001, 0.0001), 10) FROM supplier
UNION ALL SELECT 'nation', count(*),
  round(greatest((0.0003 - 0.001) / (1000.0 - 100.0) * (count(*) - 100.0) + 0.001, 0.0001), 10) FROM nation""")
def alpha_by_n(spark, sf):
    """H1 on three table sizes (below, inside and above the clamp)."""
    outs = []
    for t in ("customer", "supplier", "nation"):
        c = table(spark, sf, t).agg(F.count(F.lit(1)).alias("n"))
        outs.append(c.select(F.lit(t).alias("tbl"), "n", _r(assoc.alpha_by_n(F.col("n")), 10).alias("alpha")))
    return outs[0].unionByName(outs[1]).unionByName(outs[2])
