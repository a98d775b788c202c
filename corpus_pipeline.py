"""A corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read again.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, line_runs, packing, quality_rules, simhash
from granary.llm.common import settled, table
from granary.llm.queries import tokenizer


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; lines above their host's limit leave the others."""
    return quality_rules.apply_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs leave the texts; documents of which nothing is left go."""
    return line_runs.drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as packed into sequences."""
    pieces = packing.tokenised(docs, tokenizer("byte_bpe_50k.json"))
    return packing.checksums(packing.pack(pieces), pieces)


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("decontamination", decontamination), ("packing", sequences)]

#: SimHash, spaced seeds and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
