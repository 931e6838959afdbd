"""Rows that every operator must take: nulls, empty and blank texts, repeated
rows, ties, a very long text, and extra columns with clashing names."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, rid long, size long, copies int, "
          "score double, ids string, __rid long, shard int, key string")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def text(n: int, start: int = 0) -> str:
    return " ".join(f"{WORDS[(start + k * k) % 12]}{(start + 7 * k) % 97}" for k in range(n))


def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``rows``: (doc_id, text, source)."""
    full = [(i, t, "en", s, None if t is None else len(t), 1, 2, 3, 0.5, "x", 7, 9, None) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def edge_rows() -> list[tuple]:
    long = text(30_000, 5)
    return [(1, text(40, 1), "a"), (2, text(40, 1), "b"), (3, text(40, 1), None), (4, None, "a"), (5, "", "a"), (6, " \t\n ", "b"),
            (7, "Two words", "b"), (8, "two WORDS", "b"), (9, long, "a"), (10, long, "a"), (None, text(25, 3), "c"), (None, None, None),
            (11, text(60, 4), "c"), (11, text(60, 4), "c"), (12, "é" * 50 + " 中文 text", "c"), (13, text(59, 4) + " other", "c")]


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]
