"""Stand-in inputs built from the driver tables.

The studied project reads one clinical table that is not shipped, so the
operators run on tables of the same *shape* derived from the driver's
TPC-H-like tables.  These builders only produce rows in the expected
schema; every operator applied afterwards is generic and would run
unchanged on any table of that schema.  Each builder has a DuckDB twin
(``*_SQL``) with the same formulas, used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabmill.sources.tables import table

# fixed values: the urgent order priorities and the segment code book (1..5)
URGENT = ["1-URGENT", "2-HIGH"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SENTINEL = -9

_URGENT_SQL = "('1-URGENT', '2-HIGH')"


def urgent(col: str = "o_orderpriority") -> Column:
    return F.col(col).isin(URGENT).cast("int")


def seg_code(col: str = "c_mktsegment") -> Column:
    m = F.create_map(*[x for i, s in enumerate(SEGMENTS, 1) for x in (F.lit(s), F.lit(i))])
    return m[F.col(col)]


_SEG_SQL = ("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 "
            "WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END")


def study(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer with orders (the 'patient'); the others are not in it:

    id bigint, acctbal double, n_orders bigint, avg_price double,
    max_price double, share_f double, seg int (1..5), nation int,
    region int, big int (acctbal > 5000), label int (share of urgent/high
    orders above 0.4).  Orders are aggregated per customer before the join.
    """
    o = table(spark, sf, "orders")
    per_cust = o.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("__cents"),
        F.max("o_totalprice").alias("max_price"),
        F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 4).alias("share_f"),
        F.avg(urgent().cast("double")).alias("__u"))
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"),
        seg_code().alias("seg"), F.col("c_nationkey").alias("nation"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"),
                                          F.col("n_regionkey").alias("region"))
    df = c.join(per_cust, "id", "inner").join(n, "nation", "inner")
    # mean price in whole cents (integer division), exact in any engine
    avg_price = (F.expr("__cents div n_orders") / 100.0).alias("avg_price")
    return df.select(
        "id", "acctbal", "n_orders", avg_price, "max_price", "share_f", "seg", "nation", "region",
        (F.col("acctbal") > 5000).cast("int").alias("big"),
        (F.col("__u") > 0.4).cast("int").alias("label"))


STUDY_SQL = f"""
study AS (
  SELECT c.c_custkey AS id, c.c_acctbal AS acctbal, p.n_orders, p.avg_price, p.max_price, p.share_f,
         {_SEG_SQL} AS seg, c.c_nationkey AS nation, n.n_regionkey AS region,
         CAST(c.c_acctbal > 5000 AS INTEGER) AS big, CAST(p.u > 0.4 AS INTEGER) AS label
  FROM customer c
  JOIN (SELECT o_custkey, count(*) AS n_orders,
               (sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*)) / 100.0::DOUBLE AS avg_price,
               max(o_totalprice) AS max_price,
               round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS share_f,
               avg(CASE WHEN o_orderpriority IN {_URGENT_SQL} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS u
        FROM orders GROUP BY o_custkey) p ON p.o_custkey = c.c_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey)"""

STUDY_COLS = ["id", "acctbal", "n_orders", "avg_price", "max_price", "share_f", "seg", "nation",
              "region", "big", "label"]


def study_missing(spark: SparkSession, sf: str) -> DataFrame:
    """``study`` with the sentinel -9 in some cells (the data dictionary's
    missing marker): avg_price where id % 23 = 0, seg where id % 29 = 0,
    max_price where id % 37 = 0, and four cells where id % 97 = 0 (40% of
    the row: above the 10% rule)."""
    s = study(spark, sf)
    i = F.col("id")

    def inj(col: str, cond: Column) -> Column:
        return F.when(cond, F.lit(SENTINEL).cast(s.schema[col].dataType)).otherwise(F.col(col)).alias(col)

    heavy = i % 97 == 0
    return s.select(
        "id",
        inj("acctbal", heavy), inj("n_orders", heavy),
        inj("avg_price", (i % 23 == 0)), inj("max_price", (i % 37 == 0) | heavy),
        inj("share_f", heavy), inj("seg", i % 29 == 0), "nation", "region", "big", "label")


STUDY_MISSING_SQL = STUDY_SQL + """,
study_missing AS (
  SELECT id,
    CASE WHEN id % 97 = 0 THEN -9.0::DOUBLE ELSE acctbal END AS acctbal,
    CASE WHEN id % 97 = 0 THEN -9 ELSE n_orders END AS n_orders,
    CASE WHEN id % 23 = 0 THEN -9.0::DOUBLE ELSE avg_price END AS avg_price,
    CASE WHEN id % 37 = 0 OR id % 97 = 0 THEN -9.0::DOUBLE ELSE max_price END AS max_price,
    CASE WHEN id % 97 = 0 THEN -9.0::DOUBLE ELSE share_f END AS share_f,
    CASE WHEN id % 29 = 0 THEN -9 ELSE seg END AS seg,
    nation, region, big, label
  FROM study)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Long table (id, model, p, label) of five deterministic 'model'
    scores per order, p in [0, 1]; label = urgent/high priority.  Model
    names follow 'family_run'."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lab = urgent()
    price = F.floor(F.col("o_totalprice"))
    forms = {
        "logit_1": F.pmod(k * 37 + 11, F.lit(1000)) / 1000.0,
        "logit_2": 0.6 * lab + 0.4 * (F.pmod(k * 17 + 3, F.lit(1000)) / 1000.0),
        "rfc_1": F.pmod(price, F.lit(1000)) / 1000.0,
        "knn_1": 0.3 * lab + 0.7 * (F.pmod(c * 53 + k, F.lit(997)) / 997.0),
        "gbm_1": 0.5 * lab + 0.5 * (F.pmod(k * 7 + c, F.lit(1000)) / 1000.0),
    }
    arr = F.array(*[F.struct(F.lit(m).alias("model"), f.cast("double").alias("p")) for m, f in forms.items()])
    return o.select(k.alias("id"), lab.alias("label"), F.explode(arr).alias("s")).select(
        "id", "s.model", "s.p", "label")


SCORES_SQL = f"""
olab AS (SELECT o_orderkey AS k, o_custkey AS c, floor(o_totalprice) AS price,
                CASE WHEN o_orderpriority IN {_URGENT_SQL} THEN 1 ELSE 0 END AS label FROM orders),
scores AS (
  SELECT k AS id, 'logit_1' AS model, ((k*37+11) % 1000) / 1000.0::DOUBLE AS p, label FROM olab
  UNION ALL SELECT k, 'logit_2', 0.6::DOUBLE*label + 0.4::DOUBLE*(((k*17+3) % 1000) / 1000.0::DOUBLE), label FROM olab
  UNION ALL SELECT k, 'rfc_1', (price % 1000) / 1000.0::DOUBLE, label FROM olab
  UNION ALL SELECT k, 'knn_1', 0.3::DOUBLE*label + 0.7::DOUBLE*(((c*53+k) % 997) / 997.0::DOUBLE), label FROM olab
  UNION ALL SELECT k, 'gbm_1', 0.5::DOUBLE*label + 0.5::DOUBLE*(((k*7+c) % 1000) / 1000.0::DOUBLE), label FROM olab)"""


def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, yr, mo, day) from o_orderdate with a two-digit year; the invalid
    date 30 Feb 86 is placed where id % 501 = 0 (the data's known defect)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    bad = F.col("o_orderkey") % 501 == 0
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(bad, F.lit(86)).otherwise(F.year("o_orderdate") % 100).cast("int").alias("yr"),
        F.when(bad, F.lit(2)).otherwise(F.month("o_orderdate")).cast("int").alias("mo"),
        F.when(bad, F.lit(30)).otherwise(F.dayofmonth("o_orderdate")).cast("int").alias("day"))


DATE_PARTS_SQL = """
date_parts AS (
  SELECT o_orderkey AS id,
    CAST(CASE WHEN o_orderkey % 501 = 0 THEN 86 ELSE year(o_orderdate) % 100 END AS INTEGER) AS yr,
    CAST(CASE WHEN o_orderkey % 501 = 0 THEN 2 ELSE month(o_orderdate) END AS INTEGER) AS mo,
    CAST(CASE WHEN o_orderkey % 501 = 0 THEN 30 ELSE day(o_orderdate) END AS INTEGER) AS day
  FROM orders)"""


def packed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(line_no, value) text lines of a token stream: one record of 4 tokens
    per customer (key, nation, balance in cents, the constant 'name'),
    records cut across lines of 3 tokens, with irregular blank runs."""
    from tabmill.operators.ordering import row_index
    c = table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    r = row_index(c, ["c_custkey"], "r")
    toks = r.select(F.explode(F.array(
        F.struct((F.col("r") * 4).alias("pos"), F.col("c_custkey").cast("string").alias("tok")),
        F.struct((F.col("r") * 4 + 1).alias("pos"), F.col("c_nationkey").cast("string").alias("tok")),
        F.struct((F.col("r") * 4 + 2).alias("pos"), F.col("cents").cast("string").alias("tok")),
        F.struct((F.col("r") * 4 + 3).alias("pos"), F.lit("name").alias("tok")))).alias("t")).select("t.*")
    lines = toks.groupBy((F.col("pos") / 3).cast("long").alias("line_no")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("a"))
    return lines.select("line_no", F.concat(F.lit("  "), F.array_join(F.transform("a", lambda x: x["tok"]), "   "),
                                            F.lit(" ")).alias("value"))


PACKED_TOKENS_SQL = """
cr AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS r, c_custkey, c_nationkey,
              CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer),
toks AS (SELECT r * 4 AS pos, CAST(c_custkey AS VARCHAR) AS token FROM cr
         UNION ALL SELECT r * 4 + 1, CAST(c_nationkey AS VARCHAR) FROM cr
         UNION ALL SELECT r * 4 + 2, CAST(cents AS VARCHAR) FROM cr
         UNION ALL SELECT r * 4 + 3, 'name' FROM cr)"""


def dup_ids(spark: SparkSession, sf: str) -> DataFrame:
    """(id, seq, v): customer keys where every 50th pair shares one id
    (id = key - key % 2 when key % 100 < 2)."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(F.when(k % 100 < 2, k - k % 2).otherwise(k).alias("id"), k.alias("seq"),
                    F.col("c_acctbal").alias("v"))


DUP_IDS_SQL = """
dup_ids AS (SELECT CASE WHEN c_custkey % 100 < 2 THEN c_custkey - c_custkey % 2 ELSE c_custkey END AS id,
                   c_custkey AS seq, c_acctbal AS v FROM customer)"""
