"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as Parquet and gives
the file to the next stage. All but the last return the columns of `documents`; the mixing stage repeats
rows where a target needs it, and the last one counts these copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, line_dedup, mixing, near_dedup, quality_rules
from tidemark.llm._common import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; n_chars counts what is left.

    A document all of whose lines were later copies goes.
    """
    left = line_dedup.without_repeated_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id."""
    return near_dedup.first_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the weights that meet the source, language and topic targets."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, copies) of every document; equal rows are one with their number."""
    return byte_bpe.encoding_digest(docs).groupBy("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").agg(F.count(F.lit(1)).alias("copies"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("mixing", mix),
    ("byte-level BPE", tokens),
]

#: Weighted sampling and the merges of the tokenizer have no SQL form; tests/llm/test_pipeline.py
#: holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch(spark, stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
