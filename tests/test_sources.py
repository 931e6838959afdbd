"""Text source on a real file, strict numeric cast, snapshot reload."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabmill.sources import snapshot, text


def _write(lines: str) -> str:
    d = tempfile.mkdtemp(prefix="tabmill-text-")
    path = os.path.join(d, "records.txt")
    with open(path, "w") as f:
        f.write(lines)
    return path


def test_text_file_tokens_records_cast(spark):
    # two records of width 4 spread over lines of irregular length, blank runs
    path = _write("  1132   63 1\nname 1133\n\n  55   0   name\n")
    toks = text.token_stream(text.read_lines(spark, path))
    assert [r["token"] for r in toks.orderBy("pos").collect()] == \
        ["1132", "63", "1", "name", "1133", "55", "0", "name"]
    rec = text.regroup(toks, 4, ["id", "age", "sex", "name"])
    assert rec.where(F.col("name") != "name").count() == 0
    rec = text.to_numeric(rec.drop("name"), ["id", "age", "sex"])
    assert [tuple(r) for r in rec.orderBy("record_no").collect()] == [(0, 1132, 63, 1), (1, 1133, 55, 0)]


def test_strict_cast_fails_on_bad_token(spark):
    path = _write("1 2 x name\n")
    rec = text.regroup(text.token_stream(text.read_lines(spark, path)), 4, ["a", "b", "c", "d"])
    assert text.bad_tokens(rec, ["a", "b", "c"]).count() == 1
    assert text.to_numeric(rec, ["a", "b", "c"], strict=False).first()["c"] is None
    with pytest.raises(Exception):
        text.to_numeric(rec, ["a", "b", "c"], strict=True).collect()


def test_snapshot_load_or(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(5).withColumn("x", F.col("id") * 2)

    path = snapshot.scratch_path(spark, "t")
    a = snapshot.load_or(spark, path, build)
    b = snapshot.load_or(spark, path, build)
    assert len(built) == 1 and sorted(r["x"] for r in b.collect()) == [0, 2, 4, 6, 8] and a.count() == 5
