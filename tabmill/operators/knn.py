"""Exact k-nearest-neighbour join without a cross join, votes and weighted
means over the neighbours (survey C3, J15).

``knn_join`` searches a partitioned k-d tree index (``knn_index``); ties are
broken by (round(distance, 9), training id), as a brute-force ranking would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabmill.operators import knn_index


def knn_join(queries: DataFrame, train: DataFrame, feats: Sequence[str], k,
             qid: str = "id", tid: str = "id", out_q: str = "qid", out_t: str = "tid",
             carry: Sequence[str] = (), blocks: Sequence[Sequence[str]] = (),
             salt: int = 1, leaf_rows: int | None = None) -> DataFrame:
    """Rows (out_q, out_t, dist, rank, *carry) - the k nearest training rows
    of every query row (rank 1 = nearest).  ``qid`` / ``tid`` name the id
    columns of the two inputs; ``carry`` are training columns passed
    through (labels / values to vote on).  ``k`` is an int or a function of
    the number of training rows.  ``leaf_rows`` sets the least rows of an
    index leaf.  ``blocks`` and ``salt`` are taken for callers that describe
    their encodings or their skew; the index finds both by itself.

    Training rows with a null or NaN feature are nobody's neighbours, and a
    query with one has none; fewer than k training rows are all neighbours.
    """
    return knn_index.join(queries, train, list(feats), k, qid, tid, out_q, out_t, carry, leaf_rows)


def knn_sums(queries: DataFrame, train: DataFrame, feats: Sequence[str], k, y: str, qid: str = "id", tid: str = "id",
             by_value: bool = False, leaf_rows: int | None = None) -> DataFrame:
    """Weighted sums over the neighbours that ``knn_join`` finds, one row per
    query (and value of y if ``by_value``): what ``mean_of_sums`` and
    ``vote_of_sums`` need, without a row per neighbour."""
    return knn_index.sums(queries, train, list(feats), k, qid, tid, y, by_value, leaf_rows)


def mean_of_sums(sums: DataFrame, qid: str) -> DataFrame:
    """``weighted_mean`` by distance, from ``knn_sums``."""
    exact = F.col("zeros") > 0
    return sums.select(qid, F.when(exact, F.try_divide("zeros_y", "zeros")).otherwise(F.try_divide("wy", "w")).alias("prediction"))


def vote_of_sums(sums: DataFrame, qid: str, y: str) -> DataFrame:
    """``vote`` by distance, from ``knn_sums`` by value."""
    best = [F.min_by(F.col(y), F.struct((-F.col(c)).alias("a"), F.col(y).alias("b"))).alias(c) for c in ("zeros", "w")]
    return sums.groupBy(qid).agg(F.max("zeros").alias("most"), *best).select(
        qid, F.when(F.col("most") > 0, F.col("zeros")).otherwise(F.col("w")).alias("prediction"))


def distance_weights(nb: DataFrame, qid: str, weights: str = "distance") -> DataFrame:
    """Neighbour weights: 1/distance, or - when a query has a neighbour at
    distance 0 - weight 1 for those and 0 for the rest; ``uniform`` gives 1."""
    if weights == "uniform":
        return nb.withColumn("w", F.lit(1.0))
    zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy(qid))
    return nb.withColumn("w", F.when(zero == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist")))


def vote(nb: DataFrame, qid: str, y: str, weights: str = "distance") -> DataFrame:
    """Weighted majority label per query; ties -> the lowest label."""
    w = distance_weights(nb, qid, weights)
    per = w.groupBy(qid, y).agg(F.sum("w").alias("__ws"))
    return per.groupBy(qid).agg(F.min_by(F.col(y), F.struct((-F.col("__ws")).alias("a"), F.col(y).alias("b")))
                                .alias("prediction"))


def class_probability(nb: DataFrame, qid: str, y: str, positive=1, weights: str = "distance") -> DataFrame:
    """Share of (weighted) neighbour votes for the positive class."""
    w = distance_weights(nb, qid, weights)
    return w.groupBy(qid).agg((F.sum(F.when(F.col(y) == positive, F.col("w")).otherwise(0.0)) / F.sum("w"))
                              .alias("proba"))


def weighted_mean(nb: DataFrame, qid: str, y: str, weights: str = "distance") -> DataFrame:
    """Distance-weighted mean of the neighbours' values."""
    w = distance_weights(nb, qid, weights)
    return w.groupBy(qid).agg((F.sum(F.col("w") * F.col(y)) / F.sum("w")).alias("prediction"))


def grid_accuracy(nb: DataFrame, truth: DataFrame, qid: str, y: str, grid: Sequence[tuple[int, str]]) -> DataFrame:
    """(k, weights, accuracy) of ``vote`` over the neighbours of rank up to k,
    for all pairs of the grid in one pass over the neighbours: sums per query
    and label for every k, then the best label of each pair, held against
    ``truth`` (qid, truth; one row per query)."""
    near, zero = (lambda k: F.col("rank") <= k), F.col("dist") == 0
    per = nb.groupBy(qid, y).agg(*[c for k in sorted({k for k, _ in grid}) for c in (
        F.count_if(near(k)).alias(f"n{k}"), F.count_if(near(k) & zero).alias(f"z{k}"),
        F.sum(F.when(near(k) & ~zero, 1.0 / F.col("dist")).otherwise(0.0)).alias(f"s{k}"))])
    # at most k labels a query
    of = per.groupBy(qid).agg(F.collect_list(F.struct(*[c for c in per.columns if c != qid])).alias("__of"))

    def best(weight: str) -> Column:
        return F.array_min(F.transform("__of", lambda x: F.struct((-x[weight]).alias("a"), x[y].alias("b"))))["b"]

    def exact(k: int) -> Column:
        return F.exists("__of", lambda x: x[f"z{k}"] > 0)
    picks = []
    for i, (k, w) in enumerate(grid):
        label = best(f"n{k}") if w == "uniform" else F.when(exact(k), best(f"z{k}")).otherwise(best(f"s{k}"))
        picks.append(label.alias(f"p{i}"))
    picked = of.select(qid, *picks).join(truth, qid)
    scored = picked.agg(*[F.avg((F.col(f"p{i}") == F.col("truth")).cast("double")).alias(f"a{i}") for i in range(len(grid))])
    cells = [F.struct(F.lit(k).alias("k"), F.lit(w).alias("weights"), F.col(f"a{i}").alias("accuracy")) for i, (k, w) in enumerate(grid)]
    return scored.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
