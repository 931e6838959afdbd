"""Whitespace token streams: scan, record reassembly, schema, numeric cast
(survey A1-A4).

A record of the source format spans several physical lines; only the token
count per record is fixed.  Lines are split into tokens with built-in array
functions, each token gets its global position through distributed running
sums of the per-line token counts (no single-task window), and records are
regrouped with ``pos div width``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabmill.functions.scalars import tokens
from tabmill.operators.ordering import row_index, running_sums
from tabmill.session import cut_lineage


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text scan with line numbers that run through the files in path order,
    through each file's splits by offset and through each split's lines.
    (Spark packs splits into tasks by size, so a task id alone mixes files.)
    The lines are materialised once in the checkpoint folder, so every later
    branch (and any recomputation) sees the same numbers."""
    df = spark.read.text(path)
    lines = cut_lineage(df.select("value", F.col("_metadata.file_path").alias("file"),
                                  F.col("_metadata.file_block_start").alias("start"),
                                  F.monotonically_increasing_id().alias("at")))
    numbered = row_index(lines, ["file", "start", "at"], "line_no")
    return cut_lineage(numbered.select("line_no", "value"))


def token_stream(lines: DataFrame, line_col: str = "line_no", value_col: str = "value") -> DataFrame:
    """A1: (pos, token) for every non-empty whitespace-separated token, pos
    0-based in (line, position-in-line) order."""
    split = lines.select(F.col(line_col).alias("line_no"), tokens(F.col(value_col)).alias("toks"))
    split = split.where(F.size("toks") > 0)
    off = running_sums(split, ["line_no"], {"__before": F.size("toks")}, inclusive=False)
    return off.select(F.posexplode("toks").alias("k", "token"), "__before").select(
        (F.col("__before") + F.col("k")).cast("long").alias("pos"), "token")


def regroup(tokens_df: DataFrame, width: int, names: Sequence[str] | None = None) -> DataFrame:
    """A2/A3: consecutive tokens grouped every ``width`` into one row
    (record_no, then one column per field, named by ``names``).  Each group
    holds exactly ``width`` tokens, so the aggregation is bounded."""
    names = list(names or [f"f{i}" for i in range(width)])
    if len(names) != width:
        raise ValueError("one name per field")
    t = tokens_df.select((F.col("pos") / width).cast("long").alias("record_no"),
                         (F.col("pos") % width).cast("int").alias("field"), "token")
    return t.groupBy("record_no").agg(*[F.max(F.when(F.col("field") == i, F.col("token"))).alias(n)
                                        for i, n in enumerate(names)])


def to_numeric(df: DataFrame, cols: Sequence[str], dtype: str = "bigint", strict: bool = True) -> DataFrame:
    """A4: cast columns to numbers.  ``strict`` raises on the first bad
    token (ANSI cast); otherwise bad tokens become NULL (``try_cast``)."""
    if strict:
        return df.withColumns({c: F.col(c).cast(dtype) for c in cols})
    return df.withColumns({c: F.col(c).try_cast(dtype) for c in cols})


def bad_tokens(df: DataFrame, cols: Sequence[str], dtype: str = "bigint") -> DataFrame:
    """Rows with a token that does not parse (the report a strict cast would
    stop on)."""
    cond = None
    for c in cols:
        b = F.col(c).isNotNull() & F.col(c).try_cast(dtype).isNull()
        cond = b if cond is None else (cond | b)
    return df.where(cond)
