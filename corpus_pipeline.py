"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last
return the columns of ``documents``; every decision takes effect: rejected,
repeated and near-repeated documents go, the mix takes a document as often as
its copies say, and the last stage encodes what is left.

SQL can express none of the similarity, classifier and tokenizer stages, so
ORACLE_SQL is None and tests/llm holds each stage against a plain version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabmill.llm import bpe, dedup_mph, jaccard_rtree, mix, quality_zstd
from tabmill.llm.common import arrow_rows, located, pick
from tabmill.session import cut_lineage
from tabmill.sources.tables import table

#: Similarity in hundredths at which two documents are near duplicates, and words of a shingle.
NEAR, NEAR_WORDS = 80, 5
#: Documents of an Arrow batch.  Python workers serve all stages and keep the memory
#: of their largest batch, so every stage that calls Python bounds its batches.
BATCH_ROWS = 512


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    held, rid = located(docs, "doc_id")
    with arrow_rows(spark, BATCH_ROWS):
        stay = cut_lineage(quality_zstd.accepted(held, table(spark, sf_dir, "labels")).select(rid))
    return pick(held, stay, rid).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return dedup_mph.drop_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8)."""
    return jaccard_rtree.one_per_group(docs, threshold=NEAR, words=NEAR_WORDS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: each document as often as taken."""
    return mix.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, with digests of the ids and of the decoded bytes."""
    with arrow_rows(spark, BATCH_ROWS):
        done = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        return cut_lineage(done.select(
            "doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
            F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("encoding", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
