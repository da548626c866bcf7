"""A training corpus from raw documents: rules, near-duplicates, repeated passages, the mix, and its encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes and reads again before the next stage. All but the
last return the columns of documents. Near-dedup keeps one row of each group: one with the least doc_id, or any where none has a doc_id.
A document that the mix takes twice is two rows from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colonnade.llm import mixing, near_copies, pieces, quality, substring
from colonnade.llm.common import materialise
from colonnade.llm.registry import table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.dedup(docs, threshold=0.8, size=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(docs, tokenizer_path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("encode", encode)]

#: Fingerprints by XXH64, drawn copies and piece ids are not in SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
