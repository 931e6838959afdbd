"""The pipeline's stages, their decisions, and the queries' DuckDB twins."""

import re

import duckdb
import pytest

import corpus_pipeline
from tabmill.llm import registry
from tabmill.session import cut_lineage
from tests.conftest import SF001
from tests.llm.helpers import docs, edge_rows
from tools.check import _rows

SF = SF001.replace("sf0.001", "sf0.01")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, name):
    from tabmill.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sdf, rel = registry.QUERIES[name](spark, SF001), con.sql(registry.ORACLES[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(rel.columns, rel.fetchall())


def test_one_query_per_operator():
    assert [n for n in range(1, 11) if sum(re.match(rf"op{n}_", q) is not None for q in registry.QUERIES) == 1] == list(range(1, 11))
    assert "pipeline" in registry.QUERIES


def test_stages_take_effect(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    # a clean document in the tables' own style, and the same shouted
    clean = [r["text"].split() for r in given.where("doc_id IN (6, 7, 9)").orderBy("doc_id").collect()]
    base = " ".join(w for ws in clean for w in ws[::2])
    junk = " ".join(f"{w.upper()}!!" for w in base.split())
    extra = docs(spark, [(10**6 + i, base, "src0") for i in range(3)] + [(10**6 + 10, base + " tail", "src0"), (10**6 + 20, junk, "src0")])
    now = given.unionByName(extra.select(given.columns))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = cut_lineage(stage(spark, now, SF))
        if name != "encoding":
            assert now.columns == given.columns
        seen[name] = sorted(r["doc_id"] for r in now.select("doc_id").collect())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(seen["quality"])
    assert 10**6 + 20 not in kept and 10**6 in kept
    good = [i in kept for i, q in labels.items() if q == 1]
    assert sum(good) / len(good) > 0.98
    assert 10**6 + 2 in seen["exact"] and not {10**6, 10**6 + 1} & set(seen["exact"])
    assert len({10**6 + 2, 10**6 + 10} & set(seen["near"])) == 1
    assert set(seen["mixing"]) <= set(seen["near"]) and len(seen["mixing"]) > len(seen["near"])
    assert seen["encoding"] == seen["mixing"]


def test_stages_take_edge_rows_and_empty_tables(spark):
    for d in (docs(spark, edge_rows()).drop("rid", "__rid"), docs(spark, []).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            d = cut_lineage(stage(spark, d, SF001))
