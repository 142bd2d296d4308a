"""Readers by kind of file, parts of long files, and what goes with an import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import first_match, safe_id
from tidemark.lexicons import DOCUMENT_TYPES, SUPPORTED_FORMATS
from tidemark.sources.docx import read_docx

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {".docx": read_docx}


def read_blocks(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Blocks of the files of a kind; kinds without a reader are an error."""
    reader = READERS.get(suffix.lower())
    if reader is None:
        raise ValueError(f"no reader for {suffix}; there are {', '.join(sorted(READERS))}")
    return reader(spark, path)


def files_with_cache(spark: SparkSession, path: str, cache: DataFrame) -> DataFrame:
    """(path, suffix, doc_id, file_hash, supported, cached): the files at a path, and which the cache (file_hash) has."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("file_hash"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", "")
    rows = files.select("path", suffix.alias("suffix"), safe_id(stem).alias("doc_id"), "file_hash").withColumn("supported", F.col("suffix").isin(*SUPPORTED_FORMATS))
    return rows.join(cache.select("file_hash", F.lit(True).alias("cached")).distinct(), "file_hash", "left").na.fill(False, ["cached"])


def page_ranges(files: DataFrame, parts: int) -> DataFrame:
    """(path, part, first_page, last_page): the pages of each file in at most `parts` equal ranges, counted from 1."""
    width = F.ceil(F.col("n_pages") / parts)
    rows = files.where("n_pages > 0").select("path", "n_pages", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    rows = rows.select("path", "part", (F.col("part") * F.col("w") + 1).alias("first_page"), F.least((F.col("part") + 1) * F.col("w"), F.col("n_pages")).alias("last_page"))
    return rows.where("first_page <= last_page")


def merged_parts(parts: DataFrame) -> DataFrame:
    """Blocks (doc_id, part, pos, page, ...) of parsed ranges in one order, numbered anew from 0."""
    return parts.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "pos")) - 1).cast("int")).drop("part")


def merged_toc(toc: DataFrame) -> DataFrame:
    """(doc_id, level, heading, page): headings that several ranges report, each once with its lowest page."""
    return toc.groupBy("doc_id", "level", "heading").agg(F.min("page").alias("page"))


def merged_summary(parts: DataFrame) -> DataFrame:
    """(doc_id, summary): the first summary that a range has."""
    return parts.groupBy("doc_id").agg(F.min_by("summary", F.when(F.col("summary").isNotNull(), F.col("part"))).alias("summary"))


def document_type(name: Column) -> Column:
    """The type of a standard's document by the first prefix of its name that fits."""
    upper = F.upper(name)
    return first_match(upper, [(upper.startswith(p), F.lit(t)) for p, t in DOCUMENT_TYPES], F.lit("OTHER"))


def format_result(suffix: Column, parsed: Column) -> Column:
    """(verdict, score, confidence, rule_id): whether the format is supported and the file was parsed."""
    known = F.lower(suffix).isin(*SUPPORTED_FORMATS)
    rule = F.when(~known, "T2.format").when(~parsed, "T2.parse_failure")
    ok = known & parsed
    return F.struct(F.when(ok, "pass").otherwise("fail").alias("verdict"), F.when(ok, 4).otherwise(0).cast("long").alias("score"), F.lit(100).cast("long").alias("confidence"), rule.alias("rule_id"))


def image_inventory(blocks: DataFrame, kinds: Column) -> DataFrame:
    """Image blocks with what stands before and after them and the kind that `kinds` gives them."""
    from tidemark.operators.sequence import nearest

    heading = F.when(F.col("block_type") == "heading", F.substring("text", 1, 120))
    text = F.when(F.col("block_type") == "paragraph", F.substring("text", 1, 240))
    rows = nearest(nearest(blocks, ["doc_id"], ["pos"], heading, "prev_heading", "next_heading"), ["doc_id"], ["pos"], text, "prev_text", "next_text")
    return rows.where("block_type = 'image'").withColumn("image_type", kinds)
