"""Frame algebra: projections, filters, conditional updates, joins, reshaping,
sorting and ranking (survey groups B, C, E, F, G).

Every function is ``DataFrame -> DataFrame`` (or a Column helper); nothing is
collected.  Column lists computed from ``df.columns`` are schema work on the
driver, not data movement.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabmill.operators.ordering import row_index
from tabmill.session import cut_lineage


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# --- B: projection / filter / update -------------------------------------------------

def drop_cols(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """B1: drop by list; duplicates and absent names are tolerated."""
    return df.drop(*dict.fromkeys(names))


def select_except(df: DataFrame, *excluded: Iterable[str]) -> DataFrame:
    """B2: all columns minus the union of the excluded sets, order kept."""
    out = set().union(*[set(e) for e in excluded]) if excluded else set()
    return df.select([c for c in df.columns if c not in out])


def cols_like(df: DataFrame, regex: str | None = None, prefix: str | None = None,
              suffix: str | None = None, contains: str | None = None) -> list[str]:
    """Column names by regex / prefix / suffix / substring (all must hold)."""
    names = list(df.columns)
    if regex is not None:
        names = [c for c in names if re.search(regex, c)]
    if prefix is not None:
        names = [c for c in names if c.startswith(prefix)]
    if suffix is not None:
        names = [c for c in names if c.endswith(suffix)]
    if contains is not None:
        names = [c for c in names if contains in c]
    return names


def update_where(df: DataFrame, cond: Column, updates: Mapping[str, object]) -> DataFrame:
    """Set columns where ``cond`` holds; every new value and the
    condition read the *old* row (one ``withColumns``)."""
    return df.withColumns({
        c: F.when(cond, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c))
        for c, v in updates.items()})


def binarize(df: DataFrame, col: str, threshold: float = 0) -> DataFrame:
    """Graded label -> 0/1 (values above ``threshold`` become 1)."""
    return df.withColumn(col, F.when(F.col(col) > threshold, F.lit(1)).otherwise(F.col(col)))


def ratios(df: DataFrame, specs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``name = num / den``; a zero denominator gives NULL (ANSI-safe)."""
    return df.withColumns({name: F.try_divide(F.col(num).cast("double"), F.col(den).cast("double"))
                           for num, den, name in specs})


def label_map(df: DataFrame, col: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """Code -> label through a fixed code book (a literal map: the code
    book is part of the study's specification, not data)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out or col, m[F.col(col)])


def ordered_distinct(df: DataFrame, col: str, pos: str) -> DataFrame:
    """Distinct values with their first-seen position (partial aggregate)."""
    return df.groupBy(col).agg(F.min(pos).alias("first_pos"))


def with_position(df: DataFrame, order: Sequence, name: str = "position") -> DataFrame:
    """0-based row position after a sort (distributed, see ordering)."""
    return row_index(df, order, name)


def isin_values(df: DataFrame, col: str, values) -> DataFrame:
    """Membership.  A short literal list becomes ``isin``; a DataFrame of
    values becomes a left-semi join (no size limit, shuffle or broadcast
    chosen by the optimizer)."""
    if isinstance(values, DataFrame):
        vcol = values.columns[0]
        return df.join(values.select(F.col(vcol).alias(col)).distinct(), col, "left_semi")
    return df.where(F.col(col).isin(list(values)))


# --- C: joins -------------------------------------------------------------------------

def merge_all(dfs: Sequence[DataFrame], on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Chain of equi-joins on the same key."""
    return reduce(lambda a, b: a.join(b, on, how), dfs)


def drop_rows(df: DataFrame, bad: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Remove the rows whose key appears in ``bad`` (left anti join)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(bad.select(*keys).distinct(), keys, "left_anti")


def combinations(items: DataFrame, name: str, sizes: Sequence[int], max_items: int = 20) -> DataFrame:
    """C4: every subset of the given sizes, as (combo mask, member) rows.

    Members are numbered 0..m-1 by name; subsets are the bit masks
    1..2^m-1 with ``bit_count`` in ``sizes``, produced by ``explode`` (a
    generator, no self or cross join).  ``m`` above ``max_items`` raises
    inside the plan, so the output (at most 2^max_items masks) stays bounded.
    """
    w = Window.orderBy(name)  # the item list is tiny: it is the model list
    idx = items.select(name).distinct().withColumn("idx", F.row_number().over(w) - 1)
    m = idx.select(F.count(F.lit(1))).scalar()
    guarded_m = F.when(m > max_items, F.raise_error(F.lit("too many items for subsets"))).otherwise(m)
    masks = idx.withColumn("mask", F.explode(F.sequence(F.lit(1).cast("long"),
                                                        F.pow(F.lit(2), guarded_m).cast("long") - 1)))
    members = masks.where(F.expr("(mask >> idx) & 1") == 1)
    members = members.withColumn("size", F.bit_count("mask"))
    return members.where(F.col("size").isin(list(sizes))).select("mask", "size", name, "idx")


# --- E / F: ranking, sorting, top-k ------------------------------------------------------

def rank_by(df: DataFrame, col: str, tie: str, ascending: bool = False, name: str = "rank") -> DataFrame:
    """1..n by sorted value (ties broken by ``tie``), distributed."""
    out = row_index(df, [(col, ascending), (tie, True)], name)
    return out.withColumn(name, F.col(name) + 1)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[tuple[str, bool]],
                  n: int = 1, salt: int = 0) -> DataFrame:
    """First ``n`` rows of each group after a multi-key sort.

    With ``salt > 0`` a first top-n runs per (group, hash bucket) so a hot
    group is ranked by ``salt`` tasks, then a second top-n over at most
    ``n * salt`` survivors per group.
    """
    sort_cols = [F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last() for c, asc in order]
    cols = df.columns
    cur = df
    if salt:
        cur = cur.withColumn("__salt", F.pmod(F.xxhash64(*cols), F.lit(salt)))
        w1 = Window.partitionBy(*by, "__salt").orderBy(*sort_cols)
        cur = cur.withColumn("__rn", F.row_number().over(w1)).where(F.col("__rn") <= n).drop("__rn", "__salt")
    w = Window.partitionBy(*by).orderBy(*sort_cols)
    return cur.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def top_k(df: DataFrame, order: Sequence[tuple[str, bool]], k: int) -> DataFrame:
    """global top-k (the limit is the feature); Spark plans it as
    TakeOrderedAndProject - per-partition top-k, then a k-row merge."""
    sort_cols = [F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last() for c, asc in order]
    return df.orderBy(*sort_cols).limit(k)


def sort(df: DataFrame, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """multi-key sort, NULLs last (pandas NaN placement)."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last()
                        for c, asc in order])


def dedupe_ids(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """Repair duplicated ids.  Within an id (ordered by ``order``) the
    first row keeps it; every later row gets max(id) + its running number
    among all such rows (ordered by id, then ``order``).

    The rows of duplicated ids are range-partitioned by the whole sort key
    (an id that holds most rows is cut by the later keys), and a row is its
    id's first where the row before it, in its slice or at the end of an
    earlier one, has another id: no window and no join by id.
    """
    max_id = df.select(F.max(id_col)).scalar()
    dup = (df.groupBy(id_col).agg(F.count(F.lit(1)).alias("__cnt"))
           .where(F.col("__cnt") > 1).select(id_col))
    single = df.join(dup, id_col, "left_anti")
    sort_cols = [F.col(c).asc_nulls_first() for c in (id_col, *order)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    slices = cut_lineage(df.join(dup, id_col, "left_semi").repartitionByRange(n, *sort_cols).withColumn("__pid", F.spark_partition_id()))
    across = Window.orderBy("__pid")  # one row per slice
    ends = slices.groupBy("__pid").agg(F.max(id_col).alias("__last")).select("__pid", F.lag("__last").over(across).alias("__before"))
    here = Window.partitionBy("__pid").orderBy(*sort_cols)
    before = F.coalesce(F.lag(id_col).over(here), F.col("__before"))
    marked = slices.join(F.broadcast(ends), "__pid").withColumn("__later", F.coalesce((F.col(id_col) == before).cast("long"), F.lit(0)))
    marked = cut_lineage(marked.withColumn("__at", F.sum("__later").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    offsets = marked.groupBy("__pid").agg(F.sum("__later").alias("__n")).select(
        "__pid", F.coalesce(F.sum("__n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    new_id = (F.lit(max_id) + F.col("__at") + F.col("__off")).cast(df.schema[id_col].dataType)
    fixed = marked.join(F.broadcast(offsets), "__pid").withColumn(
        id_col, F.when(F.col("__later") == 1, new_id).otherwise(F.col(id_col))).select(*df.columns)
    return single.unionByName(fixed)


# --- G: set operations and reshaping --------------------------------------------------------

def append(df: DataFrame, other: DataFrame) -> DataFrame:
    """G1: union by name, missing columns -> NULL."""
    return df.unionByName(other, allowMissingColumns=True)


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
         var: str = "variable", value: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot(list(ids), list(cols), var, value)


def transpose(df: DataFrame, key: str, cols: Sequence[str], var: str = "variable") -> DataFrame:
    """Small-frame transpose: unpivot, then pivot on the old key.
    The old key's values become column names, so this is for result tables
    (a handful of groups), never for data."""
    long = df.unpivot([key], list(cols), var, "__v")
    return long.groupBy(var).pivot(key).agg(F.first("__v"))
