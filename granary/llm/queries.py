"""The queries that apply each operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, line_runs, packing, perspectives, qda, quality_rules, simhash, suffix_array, token_files, warc
from .common import table


def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.with_mask_text(perspectives.views(table(spark, sf_dir, "conversations")))


def op2_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_passages(table(spark, sf_dir, "documents"))


def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("removed_lines")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    """The path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return token_files.read_tokens(spark, folder, manifest)


def op10_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenised(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return packing.checksums(packing.pack(pieces), pieces)


def op5_shrunk_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.line_dedup(table(spark, sf_dir, "documents"))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, files = warc.write_arc(table(spark, sf_dir, "pages"))
    return warc.read_warc(spark, *warc.convert(arcs, files)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_perspectives, op2_sparse_suffixes, op3_spaced_seeds, op4_line_frequency, op5_shrunk_qda, op6_simple8b, op7_line_runs, op8_arc_to_warc,
        op9_simhash, op10_cutting_stock
    )
}
ORACLES: dict[str, str] = {
    "op1_perspectives": perspectives.SQL, "op4_line_frequency": quality_rules.SQL, "op7_line_runs": line_runs.SQL, "op8_arc_to_warc": warc.SQL
}
