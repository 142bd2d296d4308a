"""Other sources: a parser's JSON content lists, Markdown folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of a content list that are no part of the text (fixed values of the parser's format).
FURNITURE = ("header", "footer", "page_number", "page_footnote", "aside_text")


def content_list_blocks(items: DataFrame) -> DataFrame:
    """Blocks of content-list rows (doc_id, pos, type, text, text_level, page_idx)."""
    level = F.when(F.col("text_level") >= 1, F.col("text_level"))
    kind = F.when(level.isNotNull(), "heading").when(F.col("type") == "text", "paragraph").otherwise(F.col("type"))
    return items.where(~F.coalesce(F.col("type").isin(*FURNITURE), F.lit(False))).select("doc_id", "pos", kind.alias("block_type"), "text", level.alias("heading_level"), (F.col("page_idx") + 1).alias("page"))


def summaries(blocks: DataFrame) -> DataFrame:
    """(doc_id, summary): the first text of over fifty characters, cut to three hundred."""
    return blocks.where((F.col("block_type") == "paragraph") & (F.length("text") > 50)).groupBy("doc_id").agg(F.min_by(F.substring("text", 1, 300), "pos").alias("summary"))


def table_of_contents(blocks: DataFrame) -> DataFrame:
    """(doc_id, heading_level, title, page): each heading at its lowest page."""
    return blocks.where("block_type = 'heading'").groupBy("doc_id", "heading_level", F.col("text").alias("title")).agg(F.min("page").alias("page"))


def scanned(pages: DataFrame, sample: int = 3, least: int = 50, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, is_scanned): whether the first pages hold almost no text; null text is none.

    With `docs` (doc_id) also documents without such pages are told, as not scanned.
    """
    first = pages.where(F.col("page_num") <= sample)
    found = first.groupBy("doc_id").agg((F.max(F.length(F.trim(F.coalesce("text", F.lit(""))))) < least).alias("is_scanned"))
    return found if docs is None else docs.select("doc_id").distinct().join(found, "doc_id", "left").na.fill(False, ["is_scanned"])


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of the Markdown files at a path, a row for each file."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("source"), F.col("value").alias("text"))
