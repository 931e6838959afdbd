"""Partitioned k-d tree index behind the nearest-neighbour join.

The tree is grown over all dimensions on a bounded sample of the training
rows (``SAMPLE``): a node is split in the dimension and on the side of the
median that take most of its variance, so one-hot encodings are split by
level and no single outlier stretches a cell.  Every training row is placed
in a leaf, and the leaves' boxes are those of the rows that they hold.

A search takes two rounds of (leaf, queries) groups.  In the first a query
visits the nearest leaves that hold k rows together; its k-th distance there
is a radius, and in the second round it visits every other leaf whose box
begins within it.  Nothing outside can be nearer, so the result is exact.

A leaf of more than ``PART`` rows is dealt into parts and the queries of a
leaf into chunks, so no group grows with a frequent value; of training rows
with equal features only the k first (by id) can be neighbours, and the rest
are set aside before the tree is grown.  ``sums`` serves callers that need
the neighbours' weighted sums only: it hands on no rows but those at the
edge, so what is shuffled does not grow with k.  The tree and the boxes (at most
``MAX_LEAVES``) are all that is sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tabmill.session import cut_lineage

#: Rows of the sample that shapes the tree, and bound of the number of leaves.
SAMPLE, MAX_LEAVES = 50_000, 4096
#: Least rows of a leaf, rows of a part of a leaf, queries of a chunk, and distances held at once.
LEAF, PART, CHUNK, HELD = 1024, 8192, 2048, 1 << 21
#: For sums: rows of a bin of leaves, queries of a chunk, steps that a query's range of
#: distances is counted in, and neighbours (on average) in the last step that are handed on as rows.
BIN, SUM_CHUNK, STEPS, LAST = 16_384, 8192, 32, 128


@dataclass
class Tree:
    """Nodes as arrays: rows with x[dim] <= cut go to ``below``; dim -1 is a leaf with number ``cut``."""

    dim: list[int]
    cut: list[float]
    below: list[int]
    above: list[int]
    leaves: int = 0

    def place(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.dim[node] < 0:
                out[rows] = int(self.cut[node])
            elif len(rows):
                low = x[rows, self.dim[node]] <= self.cut[node]
                todo += [(self.below[node], rows[low]), (self.above[node], rows[~low])]
        return out


def _best_cut(x: np.ndarray) -> tuple[int, float] | None:
    """Dimension and cut at (or just under) the median that take most variance; None if all rows are equal."""
    mid = np.partition(x, (len(x) - 1) // 2, axis=0)[(len(x) - 1) // 2]
    best = (0.0, None)
    for cut in (mid, np.nextafter(mid, -np.inf)):
        low = x <= cut
        n = low.sum(axis=0)
        both = (n > 0) & (n < len(x))
        a = np.where(low, x, 0.0).sum(axis=0)
        gap = a / np.maximum(n, 1) - (x.sum(axis=0) - a) / np.maximum(len(x) - n, 1)
        gain = np.where(both, n * (len(x) - n) * gap * gap, 0.0)
        d = int(gain.argmax())
        if gain[d] > best[0]:
            best = (gain[d], (d, float(cut[d])))
    return best[1]


def grow(sample: np.ndarray, rows_per_leaf: float) -> Tree:
    """Tree over the sample with at most ``rows_per_leaf`` sampled rows a leaf, as far as rows differ."""
    t = Tree([-1], [0.0], [-1], [-1])
    todo = [(0, sample)]
    while todo:
        node, x = todo.pop()
        cut = _best_cut(x) if len(x) > max(1.0, rows_per_leaf) else None
        if cut is None:
            t.cut[node], t.leaves = float(t.leaves), t.leaves + 1
            continue
        low = x[:, cut[0]] <= cut[1]
        t.dim[node], t.cut[node] = cut
        t.below[node], t.above[node] = len(t.dim), len(t.dim) + 1
        for part in (x[low], x[~low]):
            todo.append((len(t.dim), part))
            t.dim.append(-1)
            t.cut.append(0.0)
            t.below.append(-1)
            t.above.append(-1)
    return t


def box_distance(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of every row of x to every box."""
    total = np.zeros((len(x), len(low)))
    for d in range(x.shape[1]):
        v = x[:, d, None]
        total += np.square(np.maximum(0.0, np.maximum(low[:, d] - v, v - high[:, d])))
    return np.sqrt(total)


def nearest(x: np.ndarray, y: np.ndarray, k: int, order: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, distances): for each x the k nearest y within
    the radius, equal distances (to nine digits) by ``order``.  A matrix
    product sifts, exact differences decide."""
    yy = np.square(y).sum(axis=1)
    step = max(1, HELD // max(1, len(y)))
    for at in range(0, len(x), step):
        part = x[at:at + step]
        xx = np.square(part).sum(axis=1)
        square = np.maximum(0.0, xx[:, None] + yy - 2.0 * (part @ y.T))
        reach = np.square(np.minimum(radius[at:at + step], 1e150))
        if k < len(y):
            reach = np.minimum(reach, np.partition(square, k - 1, axis=1)[:, k - 1])
        slack = 1e-11 * (xx + yy.max()) + 1e-8 * (1.0 + np.sqrt(reach))
        i, j = np.nonzero(square <= (reach + slack)[:, None])
        dist = np.empty(len(i))
        for s in range(0, len(i), HELD // 16):
            e = slice(s, s + HELD // 16)
            dist[e] = np.sqrt(np.square(part[i[e]] - y[j[e]]).sum(axis=1))
        ranked = np.lexsort((order[j], np.round(dist, 9), i))
        i, j, dist = i[ranked], j[ranked], dist[ranked]
        first = np.searchsorted(i, np.arange(len(part)))
        keep = np.arange(len(i)) - first[i] < k
        yield i[keep] + at, j[keep], dist[keep]


def _vector(feats: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in feats])


def _whole(v: str) -> Column:
    """Whether every feature is a number."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))


def _first_equals(rows: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """Of rows with equal features the k with the smallest ids, in two steps so that no task gets all of a frequent one."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("tid"), F.lit(salts)))
    for keys in (["v", "salt"], ["v"]):
        salted = salted.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("tid"))).where(F.col("r") <= k).drop("r")
    return salted.drop("salt")


def _index(t: DataFrame, width: int, k, leaf_rows: int | None) -> tuple:
    """The training rows without those that are nobody's neighbours, the same
    with their leaves (written), k, the leaves' names, rows by leaf, boxes and
    the sampled vectors."""
    spark = t.sparkSession
    # rows of one hash may differ, which costs a needless look for copies only
    st = t.groupBy(F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    n = int(st["n"] or 0)
    k = int(k(n)) if callable(k) else int(k)
    if st["most"] and st["most"] > k:
        t = cut_lineage(_first_equals(t, k))
        n = t.count()

    leaf_rows = max(leaf_rows or max(LEAF, 2 * k), -(-n // MAX_LEAVES))
    sample = np.zeros((0, width))
    if n > leaf_rows:
        some = t.where(F.pmod(F.xxhash64("tid"), F.lit(-(-n // SAMPLE))) == 0) if n > SAMPLE else t
        vectors = some.select("v").toArrow()["v"].combine_chunks()  # about SAMPLE rows
        sample = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    tree = grow(sample, leaf_rows * len(sample) / max(1, n))
    sent = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=sent.value.place(np.stack(b["v"].to_numpy())))
    placed = cut_lineage(t.mapInPandas(place, StructType([*t.schema.fields, StructField("leaf", IntegerType())])))
    spans = placed.select("leaf", F.posexplode("v")).groupBy("leaf", "pos").agg(
        F.min("col").alias("a"), F.max("col").alias("b"), F.count(F.lit(1)).alias("n")).collect()  # at most MAX_LEAVES boxes
    sizes = {r["leaf"]: r["n"] for r in spans}
    names = sorted(sizes)
    spot = {leaf: i for i, leaf in enumerate(names)}
    boxes = np.zeros((2, len(names), width))
    for r in spans:
        boxes[:, spot[r["leaf"]], r["pos"]] = r["a"], r["b"]
    return t, placed, k, names, sizes, boxes, sample


def join(queries: DataFrame, train: DataFrame, feats: Sequence[str], k, qid: str, tid: str, out_q: str, out_t: str,
         carry: Sequence[str] = (), leaf_rows: int | None = None) -> DataFrame:
    """Rows (out_q, out_t, dist, rank, *carry): the k nearest training rows of every query row."""
    spark = queries.sparkSession
    held = [f"c{i}" for i in range(len(carry))]
    t = train.select(F.col(tid).alias("tid"), _vector(feats).alias("v"), *[F.col(c).alias(h) for c, h in zip(carry, held)]).where(_whole("v"))
    q = queries.select(F.col(qid).alias("qid"), _vector(feats).alias("v")).where(_whole("v"))
    t, placed, k, names, sizes, boxes, _ = _index(t, len(feats), k, leaf_rows)
    shape = spark.sparkContext.broadcast((np.array(names, np.int32), np.array([sizes[x] for x in names], np.int64), boxes))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, size, (low, high) = shape.value
        for b in batches:
            for s in range(0, len(b), 256):
                p = b.iloc[s:s + 256]
                far = box_distance(np.stack(p["v"].to_numpy()), low, high)
                by = np.argsort(far, axis=1, kind="stable")
                enough = np.cumsum(size[by], axis=1)
                if "radius" not in p:  # first round: the nearest leaves with k rows together
                    count = np.minimum((enough < k).sum(axis=1) + 1, len(leaf))
                    lists = [leaf[o[:c]] for o, c in zip(by, count)]
                else:  # second round: the others within the radius
                    reach = p["radius"].to_numpy() * (1 + 1e-9) + 1e-9
                    lists = [np.setdiff1d(leaf[f <= r], seen) for f, r, seen in zip(far, reach, p["leaves"])]
                yield p.assign(leaves=lists)

    fields = [q.schema["qid"], q.schema["v"], StructField("leaves", ArrayType(IntegerType()))]
    result = StructType([q.schema["qid"], t.schema["tid"], StructField("dist", DoubleType()), *[t.schema[h] for h in held]])

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series(dtype="object") for c in result.names})
        order = np.unique(b["tid"].to_numpy(), return_inverse=True)[1]
        found = list(nearest(np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()), k, order, a["radius"].to_numpy()))
        i, j, dist = (np.concatenate(x) for x in zip(*found))
        right = b.iloc[j].reset_index(drop=True)
        return pd.DataFrame({"qid": a["qid"].to_numpy()[i], "tid": right["tid"], "dist": dist, **{h: right[h] for h in held}})

    def search(routed: DataFrame) -> DataFrame:
        """Every query's k nearest rows in each part of the leaves that it visits."""
        if not names:
            return spark.createDataFrame([], result)
        visits = routed.select("qid", "v", "radius", F.explode("leaves").alias("leaf"))
        parts = spark.createDataFrame([(leaf, -(-sizes[leaf] // PART)) for leaf in names], "leaf int, parts long")
        per = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")).join(F.broadcast(parts), "leaf")
        per = F.broadcast(per)  # at most MAX_LEAVES rows
        x = (visits.join(per, "leaf").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")))
             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("chunks", "parts"))
        y = (placed.join(per, "leaf").withColumn("part", F.pmod(F.xxhash64("tid"), F.col("parts")))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks", "parts"))
        keys = ("leaf", "part", "chunk")
        return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInPandas(
            lambda a, b: compare(a, b), result)

    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("dist", 9), "tid"))
    endless = F.lit(float("inf"))
    first = cut_lineage(q.mapInPandas(route, StructType(fields)))
    top = cut_lineage(search(first.withColumn("radius", endless)).withColumn("rank", rank).where(F.col("rank") <= k))
    radius = top.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(endless).alias("radius"))
    # routing costs far more than its few bytes suggest: a fixed number of tasks, which small partitions aren't merged below
    known = first.join(radius, "qid").repartition(3 * spark.sparkContext.defaultParallelism)
    rest = cut_lineage(known.mapInPandas(route, StructType([*fields, StructField("radius", DoubleType())])).where("size(leaves) > 0"))
    if not rest.isEmpty():
        more = search(rest)
        top = cut_lineage(top.drop("rank").unionByName(more).withColumn("rank", rank).where(F.col("rank") <= k))  # callers read it several times
    return top.select(F.col("qid").alias(out_q), F.col("tid").alias(out_t), "dist", "rank", *[F.col(h).alias(c) for c, h in zip(carry, held)])


def within(x: np.ndarray, y: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, distances) of all pairs within the radius, and some just outside."""
    yy = np.square(y).sum(axis=1)
    step = max(1, HELD // max(1, len(y)))
    for at in range(0, len(x), step):
        part, reach = x[at:at + step], np.square(radius[at:at + step])
        xx = np.square(part).sum(axis=1)
        slack = 1e-11 * (xx + yy.max()) + 1e-8 * (1.0 + np.sqrt(reach))
        i, j = np.nonzero(xx[:, None] + yy - 2.0 * (part @ y.T) <= (reach + slack)[:, None])
        for s in range(0, len(i), HELD // 16):
            e = slice(s, s + HELD // 16)
            yield i[e] + at, j[e], np.sqrt(np.square(part[i[e]] - y[j[e]]).sum(axis=1))


def steps(d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Number of the step of [lo, hi) that a distance falls in; -1 below it, STEPS beyond it."""
    at = np.clip(np.floor((d - lo) / (hi - lo) * STEPS), 0, STEPS - 1)
    return np.where(d < lo, -1, np.where(d < hi, at, STEPS)).astype(np.int64)


def sums(queries: DataFrame, train: DataFrame, feats: Sequence[str], k, qid: str, tid: str, y: str, by_value: bool = False,
         leaf_rows: int | None = None) -> DataFrame:
    """Sums over the k nearest training rows of every query row, per value of y
    if ``by_value``: qid, y, zeros (neighbours at distance 0), zeros_y (their
    sum of y), w (sum of 1 / distance over the others), wy (of y / distance;
    0 like zeros_y if ``by_value``).  y has no nulls.

    The sample that shapes the tree gives each query a range that should hold
    its k-th distance.  The rows in and below it are counted by steps, leaf by
    leaf; a query whose range was wrong gets another, so the result is exact.
    At the end whole steps are summed where the rows are, and only the rows of
    the step with the k-th distance are ranked one by one.
    """
    spark = queries.sparkSession
    t = train.select(F.col(tid).alias("tid"), _vector(feats).alias("v"), F.col(y).alias("y")).where(_whole("v"))
    q = queries.select(F.col(qid).alias("qid"), _vector(feats).alias("v")).where(_whole("v"))
    t, placed, k, names, sizes, boxes, sample = _index(t, len(feats), k, leaf_rows)
    n = sum(sizes.values())
    k = min(k, n)
    value = t.schema["y"]
    result = StructType([q.schema["qid"], value, *[StructField(c, DoubleType()) for c in ("zeros", "zeros_y", "w", "wy")]])
    if not names:
        return spark.createDataFrame([], StructType([StructField(qid, q.schema["qid"].dataType), StructField(y, value.dataType), *result.fields[2:]]))

    bins, rows = {}, 0  # neighbouring leaves share a bin
    number = -1
    for leaf in names:
        if number < 0 or rows + sizes[leaf] > BIN:
            number, rows = number + 1, 0
        bins[leaf], rows = number, rows + sizes[leaf]
    parts: dict[int, int] = {}
    for leaf in names:  # a leaf larger than a bin has one of its own, in parts
        parts[bins[leaf]] = max(1, -(-sizes[leaf] // BIN))
    shape = spark.sparkContext.broadcast((np.array(names, np.int32), np.array([bins[x] for x in names], np.int32), boxes, sample))
    leaf_bins = F.broadcast(spark.createDataFrame([(x, bins[x]) for x in names], "leaf int, bin int"))
    bin_parts = spark.createDataFrame(sorted(parts.items()), "bin int, parts long")
    rank = k * len(sample) / n
    slack = 0.0 if len(sample) == n else 4.0 * rank ** 0.5 + 4.0

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A first range per query."""
        _, _, (low, high), known = shape.value
        lower, upper = int(rank - slack), int(np.ceil(rank + slack))
        squares = np.square(known).sum(axis=1)
        for b in batches:
            for s in range(0, len(b), 32):
                p = b.iloc[s:s + 32]
                x = np.stack(p["v"].to_numpy())
                lo = np.zeros(len(p))
                far = np.sqrt(sum(np.square(np.maximum(np.abs(x[:, d] - low[:, d].min()), np.abs(x[:, d] - high[:, d].max()))) for d in range(x.shape[1])))
                far = far * (1 + 1e-9) + 1e-8
                hi = far.copy()
                if 0 < upper <= len(known):
                    square = np.square(x).sum(axis=1)[:, None] + squares - 2.0 * (x @ known.T)
                    square = np.partition(square, [max(lower, 1) - 1, upper - 1], axis=1)
                    hi = np.minimum(far, np.sqrt(np.maximum(0.0, square[:, upper - 1])) * (1 + 1e-6) + 1e-5)
                    if lower > 0:
                        lo = np.maximum(0.0, np.sqrt(np.maximum(0.0, square[:, lower - 1])) * (1 - 1e-6) - 1e-5)
                yield p.assign(lo=lo, hi=np.maximum(hi, lo + 1e-5), far=far)
    fields = [q.schema["qid"], q.schema["v"], *[StructField(c, DoubleType()) for c in ("lo", "hi", "far")]]
    todo = cut_lineage(q.mapInPandas(ranges, StructType(fields)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per query and bin, with the leaves in it whose boxes begin within reach."""
        leaf, in_bin, (low, high), _ = shape.value
        for b in batches:
            for s in range(0, len(b), 256):
                p = b.iloc[s:s + 256]
                near = box_distance(np.stack(p["v"].to_numpy()), low, high) <= p["reach"].to_numpy()[:, None] * (1 + 1e-9) + 1e-8
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                at = np.flatnonzero(np.diff(i * np.int64(len(leaf)) + in_bin[j], prepend=-1))
                yield p.iloc[i[at]].assign(bin=in_bin[j[at]], leaves=np.split(leaf[j], at[1:]))

    def visit(found: DataFrame, compare, schema: StructType) -> DataFrame:
        """Comparisons of the queries with the rows of the bins within their reach, in groups of bounded size."""
        visits = cut_lineage(found.mapInPandas(route, StructType([
            *found.schema.fields, StructField("bin", IntegerType()), StructField("leaves", ArrayType(IntegerType()))])))
        per = F.broadcast(visits.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / SUM_CHUNK).alias("chunks")).join(F.broadcast(bin_parts), "bin"))
        a = (visits.join(per, "bin").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")))
             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("chunks", "parts"))
        b = (placed.join(leaf_bins, "leaf").join(per, "bin").withColumn("part", F.pmod(F.xxhash64("tid"), F.col("parts")))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks", "parts"))
        keys = ("bin", "part", "chunk")

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({c: pd.Series(dtype="object") for c in schema.names})
            return compare(a, b, _pairs(a, b))
        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, schema)

    counted = StructType([q.schema["qid"], *[StructField(f"n{s}", IntegerType()) for s in range(-1, STEPS)]])

    def count(a: pd.DataFrame, b: pd.DataFrame, pairs) -> pd.DataFrame:
        lo, hi = a["lo"].to_numpy(), a["hi"].to_numpy()
        total = np.zeros(len(a) * (STEPS + 2), np.int64)
        for i, _, dist in pairs:
            cell = i * (STEPS + 2) + 1 + steps(np.round(dist, 9), lo[i], hi[i])
            total += np.bincount(cell, minlength=len(total))
        total = total.reshape(-1, STEPS + 2)[:, :-1]
        some = total.any(axis=1)
        out = pd.DataFrame(total[some], columns=counted.names[1:], dtype="int32")
        out.insert(0, "qid", a["qid"].to_numpy()[some])
        return out

    def located(p_batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The step of each query's range that holds its k-th distance (``step``), or the next range (null)."""
        for p in p_batches:
            c = np.cumsum(p[counted.names[1:]].fillna(0).to_numpy(np.int64), axis=1)
            lo, hi, far = (p[x].to_numpy() for x in ("lo", "hi", "far"))
            step = (c < k).sum(axis=1) - 1  # -1: the range begins too late, STEPS: it ends too early
            inside = np.clip(step, 0, STEPS - 1)
            row = np.arange(len(p))
            need, held = k - c[row, inside], c[row, inside + 1] - c[row, inside]
            width = (hi - lo) / STEPS
            cut_lo, cut_hi = lo + inside * width, lo + (inside + 1) * width
            early, late = step < 0, step >= STEPS
            next_lo = np.where(early, 0.0, np.where(late, np.maximum(0.0, hi - 1e-8), np.maximum(lo, cut_lo - 1e-9 * (1 + lo))))
            next_hi = np.where(early, lo + 1e-8, np.where(late, np.minimum(far, 2 * hi + 1e-6), np.minimum(hi, cut_hi + 1e-9 * (1 + hi))))
            yield p[["qid", "v", "lo", "hi", "far"]].assign(
                step=pd.array(np.where(early | late, -1, step), "Int32"), need=need, held=held, next_lo=next_lo, next_hi=np.maximum(next_hi, next_lo + 1e-8))
    state = StructType([*fields, StructField("step", IntegerType()), StructField("need", LongType()), StructField("held", LongType()),
                        StructField("next_lo", DoubleType()), StructField("next_hi", DoubleType())])

    done = None
    while True:
        total = visit(todo.drop("far").withColumn("reach", F.col("hi")), count, counted).groupBy("qid").agg(*[F.sum(c).alias(c) for c in counted.names[1:]])
        now = cut_lineage(todo.join(total, "qid", "left").mapInPandas(located, state))
        again = (F.col("step") < 0)
        wide = now.where(~again).agg(F.avg("held")).first()[0]
        if wide and wide > LAST:  # a range that can't be told apart any further stays
            again = again | ((F.col("held") > LAST) & (F.col("next_hi") - F.col("next_lo") < 0.5 * (F.col("hi") - F.col("lo"))) & (F.col("hi") - F.col("lo") > 1e-6))
        settled = now.where(~again).drop("next_lo", "next_hi", "held")
        done = settled if done is None else done.unionByName(settled)
        left = now.where(again)
        if left.isEmpty():
            break
        todo = left.select("qid", "v", F.col("next_lo").alias("lo"), F.col("next_hi").alias("hi"), "far")

    ranked = StructType([*result.fields, StructField("need", LongType()), StructField("tid", t.schema["tid"].dataType), StructField("dist", DoubleType())])

    def add_up(a: pd.DataFrame, b: pd.DataFrame, pairs) -> pd.DataFrame:
        """Sums of the rows before the step; the first rows of the step one by one."""
        lo, hi, at, need = (a[c].to_numpy() for c in ("lo", "hi", "step", "need"))
        worth = b["y"].to_numpy()
        levels, level = np.unique(worth, return_inverse=True) if by_value else (np.zeros(1), np.zeros(len(b), np.int64))
        number = np.zeros(len(b)) if by_value else worth.astype(np.float64)
        size = len(a) * len(levels)
        total, edge = np.zeros((4, size)), []
        hit = np.zeros(size, bool)
        for i, j, dist in pairs:
            s = steps(np.round(dist, 9), lo[i], hi[i])
            sure = s < at[i]
            u, v, d = i[sure], j[sure], dist[sure]
            cell, zero = u * len(levels) + level[v], d == 0
            hit[cell] = True
            inverse = 1.0 / np.where(zero, np.inf, d)
            for r, x in enumerate((zero.astype(float), np.where(zero, number[v], 0.0), inverse, inverse * number[v])):
                total[r] += np.bincount(cell, x, size)
            last = s == at[i]
            edge.append((i[last], j[last], dist[last]))
        cells = np.flatnonzero(hit)
        out = pd.DataFrame({"qid": a["qid"].to_numpy()[cells // len(levels)], "y": levels[cells % len(levels)] if by_value else None,
                            **dict(zip(result.names[2:], total[:, cells])), "need": None, "tid": None, "dist": None})
        i, j, d = (np.concatenate(x) for x in zip(*edge)) if edge else (np.zeros(0, int),) * 3
        order = np.unique(b["tid"].to_numpy(), return_inverse=True)[1]
        by = np.lexsort((order[j], np.round(d, 9), i))
        i, j, d = i[by], j[by], d[by]
        few = np.arange(len(i)) - np.searchsorted(i, i) < need[i]
        i, j, d = i[few], j[few], d[few]
        rows = pd.DataFrame({"qid": a["qid"].to_numpy()[i], "y": worth[j], **dict.fromkeys(result.names[2:]), "need": need[i],
                             "tid": b["tid"].to_numpy()[j], "dist": d})
        return out if not len(rows) else rows if not len(out) else pd.concat([out.astype(object), rows.astype(object)])

    edge = F.col("dist").isNotNull()
    end = F.col("lo") + (F.col("step") + 1) * (F.col("hi") - F.col("lo")) / STEPS
    found = visit(done.drop("far").withColumn("reach", F.least("hi", end * (1 + 1e-9) + 1e-8)), add_up, ranked)
    order = Window.partitionBy("qid", edge).orderBy(F.round("dist", 9), "tid")
    found = found.withColumn("r", F.row_number().over(order)).where(~edge | (F.col("r") <= F.col("need")))
    zero, number = F.col("dist") == 0, F.lit(0.0) if by_value else F.col("y").cast("double")
    one = F.when(zero, 0.0).otherwise(F.try_divide(F.lit(1.0), F.col("dist")))
    found = found.select("qid", F.col("y"), *[F.when(edge, e).otherwise(F.col(c)).alias(c) for c, e in zip(
        result.names[2:], (zero.cast("double"), F.when(zero, number).otherwise(0.0), one, one * number))])
    keys = [F.col("qid").alias(qid), *([F.col("y").alias(y)] if by_value else [])]
    return found.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in result.names[2:]])


def _pairs(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs within reach of the queries a and the rows b, leaf by leaf; numbers of the rows in a and b."""
    x, z, reach = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()), a["reach"].to_numpy()
    lists = a["leaves"].to_numpy()
    who, leaf = np.repeat(np.arange(len(a)), [len(v) for v in lists]), np.concatenate(lists)
    home = b["leaf"].to_numpy()
    for name in np.unique(home):
        u, v = who[leaf == name], np.flatnonzero(home == name)
        if len(u):
            for i, j, dist in within(x[u], z[v], reach[u]):
                yield u[i], v[j], dist
