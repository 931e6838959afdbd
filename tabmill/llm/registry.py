"""Queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tabmill.llm import bpe, chat_collapse, cover_tree, dedup_mph, fill_middle, html_blocks, jaccard_rtree, mix, pair_bpe, prefix_trie, quality_zstd, secret_scan, shard_prefix
from tabmill.sources.tables import table


def _docs(op: Callable[[DataFrame], DataFrame], name: str = "documents"):
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_entropy_mix": _docs(mix.query),
    "op2_exact_dedup": _docs(dedup_mph.query),
    "op3_byte_bpe": _docs(bpe.query),
    "op4_secret_scan": _docs(secret_scan.query),
    "op5_html_blocks": _docs(html_blocks.query, "pages"),
    "op6_cover_tree": _docs(cover_tree.query, "embeddings"),
    "op7_jaccard_rtree": _docs(jaccard_rtree.query),
    "op8_quality_zstd": lambda spark, sf_dir: quality_zstd.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_shard_prefix": _docs(shard_prefix.query),
    "op10_chat_collapse": _docs(chat_collapse.query, "conversations"),
    "op11_prefix_trie": _docs(prefix_trie.query, "conversations"),
    "op12_pair_bpe": _docs(pair_bpe.query),
    "op13_fill_middle": _docs(fill_middle.query),
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
                     max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                     count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
              FROM documents)""",
    "op4_secret_scan": secret_scan.query_sql(),
    "op10_chat_collapse": chat_collapse.QUERY_SQL,
    "op11_prefix_trie": prefix_trie.QUERY_SQL,
    "op13_fill_middle": fill_middle.QUERY_SQL,
}
