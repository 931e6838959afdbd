"""Session construction and lineage cutting.

Cluster jobs read ``spark.checkpoint.dir`` from the session (a shared folder
named by the cluster).  Only a local-mode session without that setting gets
a private scratch folder, which is what tests need.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "tabmill",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("TABMILL_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring it from the session.

    Order: the context's current folder, then ``spark.checkpoint.dir``.  A
    local-mode session with neither gets a fresh scratch folder; on a cluster
    that is an error, because a machine-local folder does not survive the loss
    of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder")
    scratch = tempfile.mkdtemp(prefix="tabmill-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def cut_lineage(df: DataFrame, min_partitions: bool = False) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the reliable checkpoint
    folder and read it back, cutting the lineage.

    Used between the steps of iterative operators (chained imputation,
    level-wise neighbour search, model inputs) so that a lost executor
    recomputes one step, not the whole chain.  One write job (an RDD
    checkpoint would compute its input twice unless cached), and the
    re-read table carries real sizes for AQE's join planning.
    ``min_partitions`` spreads a narrow input (one unsplittable file) over
    the default parallelism first, for callers that fan rows out next.
    """
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tabmill-cut-{uuid.uuid4().hex}"
    (spread(df) if min_partitions else df).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # a known schema saves the job that would read it from the files


def spread(df: DataFrame) -> DataFrame:
    """At least the session's default parallelism of partitions (round
    robin) - a no-op for inputs that already have them, e.g. many files."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df
