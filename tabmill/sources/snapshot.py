"""Snapshots and exports (survey A5-A7): Parquet instead of pickles, CSV
with chosen, renamed columns.

Paths default to folders under the session's reliable checkpoint directory
(shared on a cluster); callers normally pass their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tabmill.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tabmill-{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, path: str) -> str:
    """A5: write a result table (overwrite)."""
    df.write.mode("overwrite").parquet(path)
    return path


def load_or(spark: SparkSession, path: str, builder: Callable[[], DataFrame]) -> DataFrame:
    """Read the snapshot if it exists, else build, save and read it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        save(builder(), path)
    return spark.read.parquet(path)


def to_csv(df: DataFrame, path: str, rename: Mapping[str, str]) -> str:
    """CSV with a header, only the renamed columns, in the given order."""
    out = df.select(*[df[c].alias(new) for c, new in rename.items()])
    out.write.mode("overwrite").option("header", True).csv(path)
    return path
