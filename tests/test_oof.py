"""Out-of-fold predictions: folds are fitted at the same time, with the same result."""

import threading

from pyspark.ml.classification import LinearSVC
from pyspark.sql import functions as F

from tabmill.operators import models as md


def _data(spark):
    d = spark.range(240).select("id", (F.col("id") % 3 + 1).cast("int").alias("fold"), F.sin(F.col("id") * 1.7).alias("a"),
                                F.cos(F.col("id") * 0.9).alias("b")).withColumn("label", (F.col("a") + 0.5 * F.col("b") > 0.1).cast("int"))
    return md.assemble(d, ["a", "b"]).cache()


def test_folds_are_fitted_together(spark):
    meet, sizes = threading.Barrier(3, timeout=60), []

    class Waiting:
        def __init__(self, n):
            sizes.append(n)

        def fit(self, rows):
            meet.wait()  # one fit after the other never gets past this
            return LinearSVC(regParam=0.01, maxIter=5).fit(rows)
    out = md.oof_predictions(Waiting, _data(spark), "id", proba=False)
    assert sorted(sizes) == [160, 160, 160] and out.count() == 240


def test_folds_as_one_after_the_other(spark):
    make = lambda n: LinearSVC(regParam=1.0 / n, maxIter=3)
    d = _data(spark)
    many, one = (md.oof_predictions(make, d, "id", proba=False, parallelism=p).collect() for p in (5, 1))
    assert sorted(many) == sorted(one) and {r["fold"] for r in many} == {1, 2, 3}
