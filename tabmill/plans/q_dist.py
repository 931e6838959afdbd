"""Distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabmill.operators import assoc, dist
from tabmill.plans.inputs import STUDY_SQL, study
from tabmill.plans.registry import query
from tabmill.sources.tables import table

R = 6


def _r(c, d=R):
    return F.round(c, d)


LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LI_LONG = "UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) " \
           "ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME variable VALUE x"


@query("skew_kurtosis", f"""SELECT variable, count(x) AS n,
  round(skewness(x) * (count(x) - 2) / sqrt(count(x) * (count(x) - 1)), 6) AS skewness,
  round(kurtosis_pop(x), 6) AS kurtosis FROM ({_LI_LONG}) GROUP BY variable""")
def skew_kurtosis(spark, sf):
    m = dist.moments(table(spark, sf, "lineitem"), LI)
    return m.select("variable", "n", _r(F.col("skewness")).alias("skewness"), _r(F.col("kurtosis")).alias("kurtosis"))


_NORM_SQL = """
m AS (SELECT variable, count(x)::DOUBLE AS n, skewness(x) * (count(x) - 2) / sqrt(count(x) * (count(x) - 1)) AS g1,
             kurtosis_pop(x) AS g2 FROM src GROUP BY variable),
a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y0,
             3.0 * (n*n + 27*n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
             3.0 * (n - 1) / (n + 1) AS e,
             24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS varb2,
             6.0 * (n*n - 5*n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb1
      FROM m),
b AS (SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2, CASE WHEN y0 = 0 THEN 1.0 ELSE y0 END AS y,
             (g2 + 3.0 - e) / sqrt(varb2) AS xk,
             6.0 + 8.0 / sb1 * (2.0 / sb1 + sqrt(1 + 4.0 / (sb1 * sb1))) AS aa FROM a),
c AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2.0 / (w2 - 1)) AS al,
             1 + xk * sqrt(2 / (aa - 4.0)) AS denom FROM b),
d AS (SELECT variable, n, g1, g2, delta * ln(y / al + sqrt(power(y / al, 2) + 1)) AS z1,
             ((1 - 2 / (9.0 * aa)) - sign(denom) * power((1 - 2.0 / aa) / abs(denom), 1 / 3.0)) / sqrt(2 / (9.0 * aa)) AS z2
      FROM c)"""


@query("normality_test", f"""WITH src AS ({_LI_LONG}), {_NORM_SQL}
SELECT variable, CAST(n AS BIGINT) AS n, round(z1, 6) AS z_skew, round(z2, 6) AS z_kurt, round(z1*z1 + z2*z2, 6) AS k2,
       round(exp(-(z1*z1 + z2*z2) / 2), 8) AS p_value,
       CAST(exp(-(z1*z1 + z2*z2) / 2) < greatest((0.0003 - 0.001) / (1000.0 - 100.0) * (n - 100.0) + 0.001, 0.0001) AS INTEGER) AS reject
FROM d""")
def normality_test(spark, sf):
    li = table(spark, sf, "lineitem")
    n = li.select(F.count(F.lit(1))).scalar()
    out = dist.normality(li, LI, assoc.alpha_by_n(n))
    return out.select("variable", "n", *[_r(F.col(c)).alias(c) for c in ("z_skew", "z_kurt", "k2")],
                      _r(F.col("p_value"), 8).alias("p_value"), "reject")


def _bc_long(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("o_totalprice").alias("variable"), F.col("o_totalprice").alias("x"))
    li = table(spark, sf, "lineitem").select(F.lit("l_extendedprice").alias("variable"),
                                             F.col("l_extendedprice").alias("x"))
    p = table(spark, sf, "part").select(F.lit("p_retailprice").alias("variable"), F.col("p_retailprice").alias("x"))
    c = table(spark, sf, "customer").select(F.lit("c_acctbal").alias("variable"), F.col("c_acctbal").alias("x"))
    return o.unionByName(li).unionByName(p).unionByName(c)


_BC_SRC = """src AS (SELECT 'o_totalprice' AS variable, o_totalprice AS x FROM orders
  UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
  UNION ALL SELECT 'p_retailprice', p_retailprice FROM part
  UNION ALL SELECT 'c_acctbal', c_acctbal FROM customer)"""


def _bc_stage(prev: str | None, half: int, step: float, name: str) -> str:
    lam = (f"round(i * {step}::DOUBLE, 9)" if prev is None else f"round({prev}.best + i * {step}::DOUBLE, 9)")
    join = f"JOIN {prev} USING (variable)" if prev else ""
    return f"""{name}v AS (SELECT z.variable, {lam} AS lam,
      var_pop(CASE WHEN {lam} = 0 THEN ln(z) ELSE (exp({lam} * ln(z)) - 1) / {lam} END) AS v
    FROM zz z {join} CROSS JOIN range({-half}, {half + 1}) r(i) GROUP BY ALL),
{name} AS (SELECT variable, lam AS best FROM {name}v
    QUALIFY row_number() OVER (PARTITION BY variable ORDER BY v, lam) = 1)"""


BOXCOX_SQL_CTES = f"""{_BC_SRC},
st AS (SELECT variable, count(x) AS n, min(x) AS mn, avg(CASE WHEN x > 0 THEN ln(x) END) AS mlog FROM src GROUP BY variable),
zz AS (SELECT s.variable, s.x / exp(st.mlog) AS z FROM src s JOIN st USING (variable) WHERE st.mn > 0),
{_bc_stage(None, 20, 0.1, 'b1')},
{_bc_stage('b1', 10, 0.01, 'b2')},
{_bc_stage('b2', 10, 0.001, 'b3')},
lam AS (SELECT st.variable, st.n, CAST(st.mn > 0 AS INTEGER) AS positive, round(b3.best, 3) AS bc_lambda
        FROM st LEFT JOIN b3 USING (variable))"""


@query("boxcox_lambda", f"WITH {BOXCOX_SQL_CTES} SELECT * FROM lam")
def boxcox_lambda(spark, sf):
    return dist.boxcox_lambda(None, long=_bc_long(spark, sf))


@query("boxcox_apply", f"""WITH {BOXCOX_SQL_CTES}
SELECT p_partkey, p_retailprice, round(CASE WHEN bc_lambda = 0 THEN ln(p_retailprice)
       ELSE (power(p_retailprice, bc_lambda) - 1) / bc_lambda END, 6) AS p_retailprice_boxcox
FROM part CROSS JOIN (SELECT bc_lambda FROM lam WHERE variable = 'p_retailprice')""")
def boxcox_apply(spark, sf):
    """H3 applied: the fitted lambda (a scalar subquery) transforms the raw column."""
    lam = dist.boxcox_lambda(None, long=_bc_long(spark, sf)).where(F.col("variable") == "p_retailprice")
    lam_v = lam.select("bc_lambda").scalar()
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return p.withColumn("p_retailprice_boxcox", _r(dist.boxcox_apply(F.col("p_retailprice"), lam_v)))


Z_COLS = ["acctbal", "avg_price", "n_orders"]


@query("zscore", f"""WITH {STUDY_SQL},
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in Z_COLS)}
       FROM study WHERE id % 100 < 67)
SELECT id, {", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}_z" for c in Z_COLS)}
FROM study CROSS JOIN st""")
def zscore(spark, sf):
    """H7: fit on the training split (id % 100 < 67), apply to all rows."""
    s = study(spark, sf)
    out = dist.zscore(s, Z_COLS, train=F.col("id") % 100 < 67, suffix="_z")
    return out.select("id", *[_r(F.col(c + "_z")).alias(c + "_z") for c in Z_COLS])


@query("pca_first_component", """WITH st AS (SELECT avg(l_quantity) AS ma, avg(l_extendedprice) AS mb,
   var_pop(l_quantity) AS va, var_pop(l_extendedprice) AS vb, covar_pop(l_quantity, l_extendedprice) AS cab FROM lineitem),
t AS (SELECT *, 0.5 * atan2(2 * cab, va - vb) AS th FROM st),
u AS (SELECT *, cos(th) AS ca, sin(th) AS sa, CASE WHEN abs(sin(th)) > abs(cos(th)) AND sin(th) < 0 THEN -1.0 ELSE 1.0 END AS fl FROM t)
SELECT l_orderkey, l_linenumber, round(((l_quantity - ma) * ca + (l_extendedprice - mb) * sa) * fl, 4) AS pca
FROM lineitem CROSS JOIN u""")
def pca_first_component(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = dist.pca1(li, "l_quantity", "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", _r(F.col("pca"), 4).alias("pca"))


@query("kde_curve", f"""WITH {STUDY_SQL},
st AS (SELECT count(avg_price) AS n, stddev_samp(avg_price) AS sd, min(avg_price) AS lo, max(avg_price) AS hi FROM study),
p AS (SELECT *, power(n::DOUBLE, -0.2) * sd AS h FROM st),
g AS (SELECT i, lo - 3.0 * h + i * ((hi - lo + 6.0 * h) / 49) AS x, n, h FROM p CROSS JOIN range(0, 50) r(i))
SELECT CAST(g.i AS INTEGER) AS i, round(g.x, 6) AS x,
       round(sum(exp(-0.5 * power((g.x - s.avg_price) / g.h, 2))) / (g.n * g.h * sqrt(2 * pi())), 12) AS density
FROM g CROSS JOIN study s GROUP BY g.i, g.x, g.n, g.h""")
def kde_curve(spark, sf):
    out = dist.kde(study(spark, sf), "avg_price", 50)
    return out.select("i", _r(F.col("x")).alias("x"), _r(F.col("density"), 12).alias("density"))


@query("normal_fit_curve", f"""WITH {STUDY_SQL},
st AS (SELECT avg(avg_price) AS mu, stddev_pop(avg_price) AS sd, min(avg_price) AS lo, max(avg_price) AS hi FROM study)
SELECT CAST(i AS INTEGER) AS i, round(lo + i * ((hi - lo) / 49), 6) AS x,
       round(exp(-0.5 * power((lo + i * ((hi - lo) / 49) - mu) / sd, 2)) / (sd * sqrt(2 * pi())), 12) AS density
FROM st CROSS JOIN range(0, 50) r(i)""")
def normal_fit_curve(spark, sf):
    out = dist.normal_fit(study(spark, sf), "avg_price", 50)
    return out.select("i", _r(F.col("x")).alias("x"), _r(F.col("density"), 12).alias("density"))
