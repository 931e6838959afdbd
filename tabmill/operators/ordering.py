"""Order-dependent building blocks that never put a whole table in one task.

A window ``ORDER BY x`` without ``PARTITION BY`` (or partitioned by a key that
may hold a third of all rows) is executed by a single task.  Here the same
running totals are computed in three distributed steps:

1. every row gets a slice id that is monotone in the sort order: the slice
   bounds are quantiles of the first sort key from one ``approxQuantile``
   pass (a hot group is split by its keys, not kept whole);
2. a running total inside each (slice, group), and each slice's total;
3. per group, the totals of the earlier slices (a table of at most
   ``slices x groups`` rows) are added as an offset.

The slice id is a pure function of the row (literal bounds), so the two
branches that read the input - and any recomputation after a lost executor
- agree on it.  (``repartitionByRange`` samples with a per-RDD seed, so two
separately planned range exchanges may disagree.)  Equal first keys share a
slice, so RANGE and ROWS semantics both hold.  Callers that need row numbers
supply a total order (unique tie-breaker).  A non-numeric first key falls
back to materialising one range-partitioned copy in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType


def _order_spec(order: Sequence) -> list[tuple[str, bool]]:
    out = []
    for o in order:
        if isinstance(o, tuple):
            out.append((o[0], bool(o[1])))
        elif isinstance(o, str):
            out.append((o, True))
        else:
            raise TypeError("order items are column names or (name, ascending) pairs")
    return out


def _sort_cols(spec: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in spec]


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _slice_ids(df: DataFrame, spec: list[tuple[str, bool]], group: list[str], n: int) -> DataFrame:
    key, asc = spec[0]
    if isinstance(df.schema[key].dataType, NumericType):
        probs = [i / n for i in range(1, n)]
        bounds = sorted(set(b for b in df.approxQuantile(key, probs, 1.0 / (4 * n)) if b is not None))
        arr = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
        k = F.col(key).cast("double")
        if asc:
            pid = F.when(k.isNull(), F.lit(0)).otherwise(F.size(F.filter(arr, lambda b: b < k)))
        else:
            pid = F.when(k.isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(arr, lambda b: b > k)))
        return df.withColumn("__pid", pid)
    from tabmill.session import cut_lineage
    parted = df.repartitionByRange(n, *[F.col(g).asc_nulls_first() for g in group], *_sort_cols(spec))
    return cut_lineage(parted.withColumn("__pid", F.spark_partition_id()))


def running_sums(df: DataFrame, order: Sequence, sums: dict[str, Column],
                 group: Sequence[str] = (), inclusive: bool = True,
                 num_partitions: int | None = None) -> DataFrame:
    """Add running totals of ``sums`` along ``order`` within ``group``.

    ``order`` items are column names (ascending) or ``(name, ascending)``
    pairs.  ``inclusive=False`` gives the total of the rows strictly before
    each row.  The groups are expected to be few (classes, models): the
    offset table holds one row per (slice, group).
    """
    group = list(group)
    spec = _order_spec(order)
    sort_cols = _sort_cols(spec)
    n = _partitions(df, num_partitions)
    vals = {f"__v_{k}": v for k, v in sums.items()}
    parted = _slice_ids(df.withColumns(vals), spec, group, n)
    w_local = (Window.partitionBy("__pid", *group).orderBy(*sort_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = parted.withColumns({f"__l_{k}": F.sum(f"__v_{k}").over(w_local) for k in sums})
    totals = parted.groupBy("__pid", *group).agg(
        *[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    w_off = (Window.partitionBy(*group).orderBy("__pid")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("__pid", *group, *[
        F.coalesce(F.sum(f"__t_{k}").over(w_off), F.lit(0)).alias(f"__o_{k}") for k in sums])
    out = local.join(offsets, ["__pid", *group], "inner")
    res = {}
    for k in sums:
        total = F.col(f"__l_{k}") + F.col(f"__o_{k}")
        res[k] = total if inclusive else total - F.col(f"__v_{k}")
    out = out.withColumns(res)
    drop = ["__pid"] + [f"__{p}_{k}" for k in sums for p in ("v", "l", "o")]
    return out.drop(*drop)


def row_index(df: DataFrame, order: Sequence, name: str = "pos",
              group: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row along a total ``order`` (within ``group``)."""
    out = running_sums(df, order, {name: F.lit(1)}, group, inclusive=False,
                       num_partitions=num_partitions)
    return out.withColumn(name, F.col(name).cast("long"))


def exact_quantiles(long_df: DataFrame, key: Sequence[str], value: str,
                    probs: dict[str, float], num_partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles of ``value`` per ``key``.

    Same definition as pandas ``quantile`` / Spark ``percentile`` /
    DuckDB ``quantile_cont``: h = p (n - 1), v[floor h] + (h - floor h)
    (v[ceil h] - v[floor h]).  Instead of holding every value of a group in
    one aggregation buffer, rows are counted per distinct value, the
    distinct values range-sorted and their counts summed by
    ``running_sums``, and only the values at the 2 x len(probs) needed
    positions are kept.  NULL values are ignored.
    """
    key = list(key)
    data = long_df.select(*key, F.col(value).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    # equal values are one row with a count from here on: a value that most rows share is no hot slice
    values = data.groupBy(*key, "__x").agg(F.count(F.lit(1)).alias("__c"))
    counts = values.groupBy(*key).agg(F.sum("__c").alias("__n"))
    ranked = running_sums(values, ["__x"], {"__r": F.col("__c")}, group=key, inclusive=False,
                          num_partitions=num_partitions)
    # the key cardinality is the number of (group, variable) pairs - small
    ranked = ranked.join(counts, key, "inner")
    want = []
    for name, p in probs.items():
        h = (F.col("__n") - 1).cast("double") * F.lit(float(p))
        want.append(F.struct(F.lit(name).alias("q"), h.alias("h")))
    def covers(at) -> Column:  # the value's rows are at positions __r to __r + __c - 1
        return (F.col("__r") <= at) & (at < F.col("__r") + F.col("__c"))

    exploded = (ranked.select(*key, "__x", "__r", "__c", F.explode(F.filter(F.array(*want), lambda w: covers(F.floor(w["h"])) | covers(F.ceil(w["h"])))).alias("__w"))
                .select(*key, "__x", "__r", "__c", F.col("__w.q").alias("q"), F.col("__w.h").alias("h")))
    agg = exploded.groupBy(*key, "q", "h").agg(
        F.max(F.when(covers(F.floor("h")), F.col("__x"))).alias("lo"),
        F.max(F.when(covers(F.ceil("h")), F.col("__x"))).alias("hi"))
    val = F.col("lo") + (F.col("h") - F.floor("h")) * (F.col("hi") - F.col("lo"))
    wide = agg.groupBy(*key).pivot("q", list(probs)).agg(F.first(val))
    return wide
