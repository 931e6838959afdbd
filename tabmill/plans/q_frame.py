"""Sources, frame algebra, joins, ranking, reshaping and scalar-function
queries (A1-A6, B, C1/C4/C6, E1-E3, F3, G1-G3, S2/S4/S5/S7/S10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabmill.functions import scalars
from tabmill.operators import frame, profile
from tabmill.plans.inputs import (DATE_PARTS_SQL, DUP_IDS_SQL, PACKED_TOKENS_SQL, SCORES_SQL, SEGMENTS, STUDY_MISSING_SQL,
                                  STUDY_SQL, date_parts, dup_ids, packed_lines, scores, study, study_missing)
from tabmill.plans.registry import query
from tabmill.sources import snapshot, text
from tabmill.sources.tables import table

R = 6


def _r(c, d=R):
    return F.round(c, d)


# ---- A: sources ----------------------------------------------------------------------------

@query("token_scan", f"WITH {PACKED_TOKENS_SQL} SELECT pos, token FROM toks")
def token_scan(spark, sf):
    return text.token_stream(packed_lines(spark, sf))


REC_NAMES = ["id", "nation", "cents", "name"]


@query("record_regroup", f"""WITH {PACKED_TOKENS_SQL}
SELECT r AS record_no, CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS nation,
       CAST(cents AS VARCHAR) AS cents, 'name' AS name FROM cr""")
def record_regroup(spark, sf):
    return text.regroup(text.token_stream(packed_lines(spark, sf)), 4, REC_NAMES)


@query("text_scan_files", f"""WITH {PACKED_TOKENS_SQL}
SELECT r AS record_no, CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS nation,
       CAST(cents AS VARCHAR) AS cents, 'name' AS name FROM cr""")
def text_scan_files(spark, sf):
    """A1/A2 from files: the packed lines are written as several text files
    (records run across lines and files), read back and regrouped."""
    path = snapshot.scratch_path(spark, "lines")
    (packed_lines(spark, sf).repartitionByRange(4, "line_no").sortWithinPartitions("line_no")
     .select("value").write.text(path))
    return text.regroup(text.token_stream(text.read_lines(spark, path)), 4, REC_NAMES)


@query("numeric_cast", f"""WITH {PACKED_TOKENS_SQL}
SELECT r AS record_no, c_custkey AS id, CAST(c_nationkey AS BIGINT) AS nation, cents FROM cr""")
def numeric_cast(spark, sf):
    rec = text.regroup(text.token_stream(packed_lines(spark, sf)), 4, REC_NAMES)
    rec = frame.drop_cols(rec, ["name"])
    return text.to_numeric(rec, ["id", "nation", "cents"], "bigint", strict=True)


@query("snapshot_roundtrip", f"WITH {STUDY_SQL} SELECT * FROM study")
def snapshot_roundtrip(spark, sf):
    """Save the study table as Parquet, then load it back."""
    path = snapshot.scratch_path(spark, "study")
    return snapshot.load_or(spark, path, lambda: study(spark, sf))


# ---- B: projection / filter / update ---------------------------------------------------------

@query("drop_columns", f"WITH {STUDY_SQL} SELECT id, acctbal, avg_price, seg, nation, region, big, label FROM study")
def drop_columns(spark, sf):
    return frame.drop_cols(study(spark, sf), ["n_orders", "max_price", "n_orders", "share_f"])


@query("select_except", f"WITH {STUDY_SQL} SELECT id, acctbal, avg_price, seg, region, label FROM study")
def select_except(spark, sf):
    """B2: all columns but two sets that overlap."""
    return frame.select_except(study(spark, sf), {"n_orders", "max_price", "share_f"}, {"nation", "big", "share_f"})


@query("transpose_means", f"""WITH {STUDY_SQL},
m AS (SELECT label, round(avg(n_orders), 6) AS n_orders, round(avg(max_price), 6) AS max_price FROM study GROUP BY label)
SELECT v.variable, max(CASE WHEN label = 0 THEN CASE v.variable WHEN 'n_orders' THEN n_orders ELSE max_price END END) AS "0",
       max(CASE WHEN label = 1 THEN CASE v.variable WHEN 'n_orders' THEN n_orders ELSE max_price END END) AS "1"
FROM m CROSS JOIN (VALUES ('n_orders'), ('max_price')) v(variable) GROUP BY v.variable""")
def transpose_means(spark, sf):
    """A result table turned: one row per variable, one column per label."""
    m = study(spark, sf).groupBy("label").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("n_orders", "max_price")])
    return frame.transpose(m, "label", ["n_orders", "max_price"])


@query("price_grid", """SELECT i / 10.0::DOUBLE AS discount, count(o) AS n
FROM range(0, 11) g(i) LEFT JOIN (SELECT CAST(round(l_discount * 10) AS BIGINT) AS o FROM lineitem) ON o = i GROUP BY i""")
def price_grid(spark, sf):
    """Rows per step of a numeric range, empty steps included."""
    n = table(spark, sf, "lineitem").groupBy(F.round(F.col("l_discount"), 1).cast("double").alias("discount")).agg(F.count(F.lit(1)).alias("c"))
    steps = spark.range(1).select(F.explode(scalars.grid(0, 10, 0.1)).alias("discount"))
    return steps.join(n, "discount", "left").select("discount", F.coalesce("c", F.lit(0)).alias("n"))


@query("share_formats", f"""WITH {STUDY_SQL}, s AS (SELECT region, avg(label::DOUBLE) AS p FROM study GROUP BY region)
SELECT region, printf('%.1f', round(p * 100, 1)) || '%' AS pct, CASE WHEN p = 0 THEN 0.0 ELSE round(round(p / pow(10.0, floor(log10(abs(p))) - 2)) * pow(10.0, floor(log10(abs(p))) - 2), 12) END AS sig3 FROM s""")
def share_formats(spark, sf):
    """Shares as per cent text and to three significant digits."""
    s = study(spark, sf).groupBy("region").agg(F.avg(F.col("label").cast("double")).alias("p"))
    return s.select("region", scalars.pct("p").alias("pct"), scalars.sig3("p").alias("sig3"))


@query("select_regex", f"WITH {STUDY_SQL} SELECT id, avg_price, max_price FROM study")
def select_regex(spark, sf):
    s = study(spark, sf)
    return s.select("id", *frame.cols_like(s, regex=r"_price$"))


@query("mask_filter", """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag FROM lineitem
WHERE (l_returnflag = 'R' AND l_quantity > 25) OR NOT (l_discount < 0.05)""")
def mask_filter(spark, sf):
    li = table(spark, sf, "lineitem")
    m = ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25)) | ~(F.col("l_discount") < 0.05)
    return li.where(m).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")


@query("conditional_update", """SELECT o_orderkey,
  CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def conditional_update(spark, sf):
    o = table(spark, sf, "orders")
    out = frame.update_where(o, (F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") == "P"),
                             {"o_orderstatus": "O"})
    return out.select("o_orderkey", "o_orderstatus")


# fixed values of the repair: 30 Feb 86 becomes 1 Mar 86
_REPAIRED_SQL = DATE_PARTS_SQL + """,
fixed AS (SELECT id, yr, CASE WHEN yr = 86 AND mo = 2 AND day = 30 THEN 3 ELSE mo END AS mo,
                 CASE WHEN yr = 86 AND mo = 2 AND day = 30 THEN 1 ELSE day END AS day FROM date_parts)"""


def _repaired(spark, sf):
    d = date_parts(spark, sf)
    return frame.update_where(d, (F.col("yr") == 86) & (F.col("mo") == 2) & (F.col("day") == 30), {"mo": 3, "day": 1})


@query("date_repair", f"WITH {_REPAIRED_SQL} SELECT id, yr, mo, day FROM fixed")
def date_repair(spark, sf):
    """Both columns updated from the old row in one step."""
    return _repaired(spark, sf)


@query("build_date", f"""WITH {_REPAIRED_SQL}
SELECT id, strftime(make_date(CASE WHEN yr < 69 THEN 2000 + yr ELSE 1900 + yr END, mo, day), '%Y-%m-%d') AS order_date
FROM fixed""")
def build_date(spark, sf):
    """Two-digit year (pivot 69), month, day -> ISO date text."""
    d = _repaired(spark, sf)
    return d.select("id", scalars.iso_date(scalars.ymd("yr", "mo", "day")).alias("order_date"))


@query("days_between", """SELECT l.l_orderkey, l.l_linenumber,
  CAST(datediff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS INTEGER) AS days
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""")
def days_between(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber",
                    scalars.days_between(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("days"))


@query("semi_isin", """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45) AND l_returnflag IN ('R', 'A')""")
def semi_isin(spark, sf):
    """A long membership list as a left-semi join, a short one as isin."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    big_parts = table(spark, sf, "part").where(F.col("p_size") > 45).select("p_partkey")
    out = frame.isin_values(li, "l_partkey", big_parts)
    return frame.isin_values(out, "l_returnflag", ["R", "A"])


@query("label_binarize", """SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS graded,
  CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 > 0 THEN 1 ELSE 0 END AS label FROM orders""")
def label_binarize(spark, sf):
    """Graded 0..4 -> 0/1."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("graded"))
    return frame.binarize(o.withColumn("label", F.col("graded")), "label")


_RATIOS = [("acctbal", "n_orders", "acctbal_div_by_n_orders"), ("max_price", "avg_price", "max_price_div_by_avg_price"),
           ("avg_price", "share_f", "avg_price_div_by_share_f")]


@query("ratio_features", f"""WITH {STUDY_SQL} SELECT id, {", ".join(
    f"round(CASE WHEN {d} = 0 THEN NULL ELSE {n} / {d} END, 6) AS {name}" for n, d, name in _RATIOS)} FROM study""")
def ratio_features(spark, sf):
    out = frame.ratios(study(spark, sf), _RATIOS)
    return out.select("id", *[_r(F.col(name)).alias(name) for _, _, name in _RATIOS])


# fixed values: code book of the balance flag
BIG_LABELS = {0: "low balance", 1: "high balance"}


@query("code_labels", f"""WITH {STUDY_SQL} SELECT id, seg, CASE seg {" ".join(
    f"WHEN {i} THEN '{s}'" for i, s in enumerate(SEGMENTS, 1))} END AS seg_name, big,
  CASE big WHEN 0 THEN 'low balance' WHEN 1 THEN 'high balance' END AS big_name FROM study""")
def code_labels(spark, sf):
    s = study(spark, sf).select("id", "seg", "big")
    s = frame.label_map(s, "seg", {i: v for i, v in enumerate(SEGMENTS, 1)}, "seg_name")
    return frame.label_map(s, "big", BIG_LABELS, "big_name")


@query("ordered_distinct", "SELECT o_orderpriority, min(o_orderkey) AS first_pos FROM orders GROUP BY 1")
def ordered_distinct(spark, sf):
    return frame.ordered_distinct(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


# ---- C / E: joins and ranking ------------------------------------------------------------------

_MISS_COLS = ["acctbal", "n_orders", "avg_price", "max_price", "share_f", "seg", "nation", "region", "big", "label"]
_MISS_SUM = " + ".join(f"CAST({c} = -9 AS INTEGER)" for c in _MISS_COLS)


@query("anti_drop", f"""WITH {STUDY_MISSING_SQL}
SELECT * FROM study_missing WHERE id NOT IN (SELECT id FROM study_missing WHERE ({_MISS_SUM}) / 10.0 > 0.10)""")
def anti_drop(spark, sf):
    """Rows removed by an index list (the sparse rows), anti join."""
    sm = study_missing(spark, sf)
    bad = profile.row_missing_share(sm, "id").where(F.col("share") > 0.10).select("id")
    return frame.drop_rows(sm, bad, "id")


@query("id_repair", f"""WITH {DUP_IDS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM dup_ids),
x AS (SELECT id, seq, v, row_number() OVER (ORDER BY id, seq) AS k FROM r WHERE rn > 1)
SELECT id, seq, v FROM r WHERE rn = 1
UNION ALL SELECT (SELECT max(id) FROM dup_ids) + k, seq, v FROM x""")
def id_repair(spark, sf):
    """Later rows of a duplicated id get max(id) + a running number."""
    return frame.dedupe_ids(dup_ids(spark, sf), "id", ["seq"])


@query("top_per_group", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def top_per_group(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return frame.top_per_group(o, ["o_custkey"], [("o_totalprice", False), ("o_orderkey", True)], 1, salt=4)


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return frame.top_k(o, [("o_totalprice", False), ("o_orderkey", True)], 10)


RANK_VARS = ["acctbal", "n_orders", "avg_price", "max_price", "share_f"]


def _importance(s):
    """|corr(variable, label)| per variable, long (one aggregate)."""
    wide = s.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col("label").cast("double"))).alias(c) for c in RANK_VARS])
    return wide.unpivot([], RANK_VARS, "variable", "importance")


_IMP_SQL = " UNION ALL ".join(f"SELECT '{c}' AS variable, abs(corr({c}, label)) AS importance FROM study"
                              for c in RANK_VARS)


@query("importance_rank", f"""WITH {STUDY_SQL}, imp AS ({_IMP_SQL})
SELECT variable, round(importance, 6) AS importance,
       row_number() OVER (ORDER BY importance DESC, variable) AS rank FROM imp""")
def importance_rank(spark, sf):
    """Rank 1..n by sorted importance (distributed numbering)."""
    imp = _importance(study(spark, sf))
    out = frame.rank_by(imp, "importance", "variable", ascending=False)
    return out.select("variable", _r(F.col("importance")).alias("importance"), F.col("rank").cast("int"))


_CV_SQL = " UNION ALL ".join(f"SELECT '{c}' AS variable, stddev_samp({c}) / abs(avg({c})) AS cv FROM study"
                             for c in RANK_VARS)
_SK_SQL = " UNION ALL ".join(f"SELECT '{c}' AS variable, abs(skewness({c})) AS sk FROM study" for c in RANK_VARS)


@query("rank_merge", f"""WITH {STUDY_SQL}, imp AS ({_IMP_SQL}), cv AS ({_CV_SQL}), sk AS ({_SK_SQL}),
r1 AS (SELECT variable, row_number() OVER (ORDER BY importance DESC, variable) AS rank_a FROM imp),
r2 AS (SELECT variable, row_number() OVER (ORDER BY cv DESC, variable) AS rank_b FROM cv),
r3 AS (SELECT variable, row_number() OVER (ORDER BY sk DESC, variable) AS rank_c FROM sk),
m AS (SELECT variable, rank_a, rank_b, rank_c, (rank_a + rank_b + rank_c) / 3.0 AS avg_rank
      FROM r1 JOIN r2 USING (variable) JOIN r3 USING (variable))
SELECT variable, CAST(rank_a AS INTEGER) AS rank_a, CAST(rank_b AS INTEGER) AS rank_b, CAST(rank_c AS INTEGER) AS rank_c,
       round(avg_rank, 6) AS avg_rank,
       CAST(row_number() OVER (ORDER BY avg_rank, variable) AS INTEGER) AS final_rank FROM m""")
def rank_merge(spark, sf):
    """Three rankings (|corr with label|, coefficient of
    variation, |skewness|) merged on the variable, averaged, re-ranked."""
    s = study(spark, sf)
    cv = s.agg(*[(F.stddev_samp(c) / F.abs(F.avg(c))).alias(c) for c in RANK_VARS]).unpivot(
        [], RANK_VARS, "variable", "cv")
    sk = s.agg(*[F.abs(F.skewness(c)).alias(c) for c in RANK_VARS]).unpivot([], RANK_VARS, "variable", "sk")
    # skewness: Spark's is the population form; DuckDB's sample-corrected form
    # ranks identically (a positive factor common to all columns)
    r1 = frame.rank_by(_importance(s), "importance", "variable", False, "rank_a").select("variable", "rank_a")
    r2 = frame.rank_by(cv, "cv", "variable", False, "rank_b").select("variable", "rank_b")
    r3 = frame.rank_by(sk, "sk", "variable", False, "rank_c").select("variable", "rank_c")
    m = frame.merge_all([r1, r2, r3], "variable")
    m = profile.rowwise(m, ["rank_a", "rank_b", "rank_c"], "__s", "__m", "avg_rank")
    out = frame.rank_by(m, "avg_rank", "variable", True, "final_rank")
    return out.select("variable", *[F.col(c).cast("int").alias(c) for c in ("rank_a", "rank_b", "rank_c")],
                      _r(F.col("avg_rank")).alias("avg_rank"), F.col("final_rank").cast("int"))


@query("model_combinations", f"""WITH {SCORES_SQL},
m AS (SELECT model, CAST(row_number() OVER (ORDER BY model) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT model FROM scores)),
k AS (SELECT mask FROM range(1, 32) t(mask) WHERE bit_count(mask) IN (1, 3, 5))
SELECT k.mask, CAST(bit_count(k.mask) AS INTEGER) AS size, m.model, m.idx FROM k JOIN m ON (k.mask >> m.idx) & 1 = 1""")
def model_combinations(spark, sf):
    """C4: subsets of size 1, 3, 5 of the scored models."""
    return frame.combinations(scores(spark, sf).select("model"), "model", [1, 3, 5]).select(
        "mask", F.col("size").cast("int"), "model", F.col("idx").cast("int"))


# ---- G: set operations and reshaping ---------------------------------------------------------

@query("union_missing_columns", """SELECT o_orderstatus, NULL::VARCHAR AS l_returnflag, count(*) AS n,
  round(avg(o_totalprice), 6) AS avg_price, NULL::DOUBLE AS avg_qty FROM orders GROUP BY o_orderstatus
UNION ALL SELECT NULL, l_returnflag, count(*), NULL, round(avg(l_quantity), 6) FROM lineitem GROUP BY l_returnflag""")
def union_missing_columns(spark, sf):
    a = table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("o_totalprice")).alias("avg_price"))
    b = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("l_quantity")).alias("avg_qty"))
    return frame.append(a, b)


@query("set_difference", f"""WITH {STUDY_MISSING_SQL},
u AS (UNPIVOT (SELECT {", ".join(f"count_if({c} = -9) AS {c}" for c in _MISS_COLS)} FROM study_missing)
      ON {", ".join(_MISS_COLS)} INTO NAME variable VALUE n_missing)
SELECT variable FROM u WHERE n_missing > 0""")
def set_difference(spark, sf):
    """All columns minus the complete ones = the columns to impute."""
    sm = study_missing(spark, sf)
    names = [c for c in sm.columns if c != "id"]
    all_cols = sm.agg(F.explode(F.array(*[F.lit(c) for c in names])).alias("variable"))
    complete = profile.complete_columns(sm, exclude=["id"])
    return all_cols.exceptAll(complete)


MODELS = ["logit_1", "logit_2", "rfc_1", "knn_1", "gbm_1"]


@query("scores_wide", f"""WITH {SCORES_SQL}
PIVOT (SELECT id, label, model, round(p, 6) AS p FROM scores) ON model IN ({", ".join(f"'{m}'" for m in MODELS)})
USING first(p) GROUP BY id, label""")
def scores_wide(spark, sf):
    """Long (id, model, p) -> one column per model (display form)."""
    s = scores(spark, sf).withColumn("p", _r(F.col("p")))
    return s.groupBy("id", "label").pivot("model", MODELS).agg(F.first("p"))


# ---- S: scalar functions -------------------------------------------------------------------------

@query("name_parts", f"""WITH {SCORES_SQL}
SELECT DISTINCT model, split_part(model, '_', 1) AS family, CAST(split_part(model, '_', 2) AS INTEGER) AS run FROM scores""")
def name_parts(spark, sf):
    m = scores(spark, sf).select("model").distinct()
    return m.select("model", scalars.part("model", "_", 1).alias("family"),
                    scalars.part("model", "_", -1).cast("int").alias("run"))


@query("k_by_sqrt_n", """SELECT o_orderstatus, count(*) AS n, CAST(round_even(sqrt(count(*)), 0) AS INTEGER) AS k,
  CAST(CASE WHEN round_even(sqrt(count(*)), 0) % 2 = 0 THEN round_even(sqrt(count(*)), 0) - 1
            ELSE round_even(sqrt(count(*)), 0) END AS INTEGER) AS k_odd
FROM orders GROUP BY o_orderstatus""")
def k_by_sqrt_n(spark, sf):
    """k = round(sqrt(n)) (half to even) and its odd variant."""
    c = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return c.select("o_orderstatus", "n", scalars.k_of_n(F.col("n")).alias("k"),
                    scalars.k_of_n(F.col("n"), force_odd=True).alias("k_odd"))


@query("format_numbers", f"""WITH {STUDY_SQL},
g AS (SELECT seg, count(*) AS n, sum(label) AS pos FROM study GROUP BY seg),
t AS (SELECT seg, n, (pos * 1000 + n // 2) // n AS tenths FROM g)
SELECT seg, n, CAST(tenths // 10 AS VARCHAR) || '.' || CAST(tenths % 10 AS VARCHAR) || '%' AS label_share FROM t""")
def format_numbers(spark, sf):
    """S10: '{{:.1%}}' text of a share, rounded half up in integer tenths of a
    percent (exact in any engine)."""
    g = study(spark, sf).groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    tenths = F.expr("(pos * 1000 + n div 2) div n")
    return g.select("seg", "n", F.concat((tenths / 10).cast("long").cast("string"), F.lit("."),
                                         (tenths % 10).cast("string"), F.lit("%")).alias("label_share"))
