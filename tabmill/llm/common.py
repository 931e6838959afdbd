"""Helpers shared by the corpus operators: safe names, checked broadcasts,
distributed prefix sums and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabmill.session import cut_lineage

#: Largest table (rows of a few numbers each) that is sent to every executor.
BROADCAST_ROWS = 200_000
#: Counters of a page of ``twice_bits``, and those that a task holds before it hands them on.
PAGE, HELD = 1 << 16, 1 << 18


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written inside go to Python in batches of at most ``rows`` rows,
    which bounds the memory of operators with wide rows; the session's own
    setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (Spark ignores case)."""
    have, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in have:
        name += "_"
    return name


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def located(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and a column of it that tells its rows apart: the id where it
    is whole, never null and never repeated, else a number that is fixed by
    writing the table once."""
    if dict(docs.dtypes)[id_col] in ("bigint", "int"):
        n, ids = docs.agg(F.count(F.lit(1)), F.countDistinct(id_col)).first()
        if n == ids:
            return docs, id_col
    rid = fresh(docs, "rid")
    return cut_lineage(docs.withColumn(rid, F.monotonically_increasing_id())), rid


def pick(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", limit: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` with (or, by left_anti, without) a key in the written
    one-column table ``ids``.  Up to ``limit`` counted ids (8 bytes each) are
    broadcast, so that wide rows aren't shuffled to be picked; more are
    joined by shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, key, how)


def join_small(big: DataFrame, small: DataFrame, on: str, how: str = "inner",
               limit: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Join a materialised table with one row per ``on`` value to a big side
    whose keys may be skewed.  Up to ``limit`` counted rows it is broadcast;
    beyond that its rows are repeated per salt and the big side's salted keys
    are joined by shuffle, so that no task gets a whole hot key."""
    if small.count() <= limit:
        return big.join(F.broadcast(small), on, how)
    salt = fresh(big, "salt")
    spread = big.withColumn(salt, F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [on, salt], how).drop(salt)


def prefix_sums(df: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Totals of the rows strictly before each row along ``order``.

    The rows are range-partitioned on the whole order (a value that many rows
    share is cut by the later keys), written once, and each partition's total
    shifts the running totals inside the later ones.  ``sums`` maps a new
    column to the summed one.  At most one total per partition meets in one
    task.
    """
    pid = fresh(df, "pid")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parted = cut_lineage(df.repartitionByRange(n, *order).withColumn(pid, F.spark_partition_id()))
    inside = Window.partitionBy(pid).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = parted.groupBy(pid).agg(*[F.sum(c).alias(f"{pid}{k}") for k, c in sums.items()])
    offsets = totals.select(pid, *[F.coalesce(F.sum(f"{pid}{k}").over(across), zero).alias(f"{pid}{k}") for k in sums])
    local = parted.withColumns({k: F.coalesce(F.sum(c).over(inside), zero) for k, c in sums.items()})
    out = local.join(F.broadcast(offsets), pid)
    return out.withColumns({k: F.col(k) + F.col(f"{pid}{k}") for k in sums}).drop(pid, *[f"{pid}{k}" for k in sums])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): node, root (the
    smallest node of its component), one row per node that has an edge.

    Each round hooks every node to its smallest neighbour, shortens the
    chains by pointer doubling and contracts the edges; only joins and
    pre-aggregated minima, each round written to the checkpoint folder.
    """
    e = cut_lineage(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut_lineage(e.selectExpr("a AS node", "a AS root").limit(0))
    first = True
    while e.count():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m"))
                        .select(F.col("a").alias("node"), F.least("a", "m").alias("parent")))
        while True:
            up = p.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            p = cut_lineage(p.join(up, "parent").select(
                "node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
            if p.where("moved").isEmpty():
                break
        p = p.select("node", "parent")
        if first:
            labels, first = p.select("node", F.col("parent").alias("root")), False
        else:
            to = p.select(F.col("node").alias("root"), "parent")
            labels = cut_lineage(labels.join(to, "root", "left").select("node", F.coalesce("parent", "root").alias("root")))
        pa = p.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        pb = p.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        e = cut_lineage(e.join(pa, "a").join(pb, "b").where("ra != rb")
                        .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return labels


def twice_bits(df: DataFrame, counters: Callable[[Iterator[pa.RecordBatch]], Iterable[np.ndarray]], n: int) -> np.ndarray:
    """A bit for each of ``n`` counters (a multiple of ``PAGE``): whether at
    least two of the values that ``counters`` draws from the rows of ``df``
    meet in it.  Tasks hand on the counters that they have touched, by pages
    and in two bytes each; a page's counts are summed up to two, and the
    driver gets n / 8 bytes, so ``n`` must be bounded by the caller."""
    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hand_on(held: list[np.ndarray]) -> pa.RecordBatch:
            cell, count = np.unique(np.concatenate(held), return_counts=True)
            page = cell // PAGE
            at = np.flatnonzero(np.diff(page, prepend=-1))
            low, many = (cell % PAGE).astype(np.uint16), count > 1
            parts = [slice(i, j) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(cell)])]
            return pa.RecordBatch.from_arrays(
                [pa.array(page[at], pa.int64()), pa.array([low[p][~many[p]].tobytes() for p in parts], pa.binary()),
                 pa.array([low[p][many[p]].tobytes() for p in parts], pa.binary())], ["page", "once", "more"])
        held, size = [], 0
        for got in counters(batches):
            held.append(got)
            size += len(got)
            if size >= HELD:
                yield hand_on(held)
                held, size = [], 0
        if size:
            yield hand_on(held)

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(PAGE, np.uint8)
        for once, more in zip(p["once"], p["more"]):
            count[np.frombuffer(more, np.uint16)] = 2
            at = np.frombuffer(once, np.uint16)
            count[at] = np.minimum(count[at] + 1, 2)
        return pd.DataFrame({"page": p["page"].iloc[:1], "bits": [np.packbits(count > 1, bitorder="little").tobytes()]})
    pages = df.mapInArrow(touch, "page long, once binary, more binary").groupBy("page").applyInPandas(merge, "page long, bits binary")
    bits = np.zeros(n // 8, np.uint8)
    for r in pages.toLocalIterator():
        bits[r["page"] * PAGE // 8:(r["page"] + 1) * PAGE // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
