"""Scans of stored relations: chunks, labels, sessions, skills, rules, tasks, versions, seeds and results."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import store

VERSION = "norm string, number_raw string, latest_year int, title string, status string, superseded_by string, source string"
CLAUSE = "clause_id string, standard_name string, clause_num string, title string, content string, tags array<string>"


def by_dimension(chunks: DataFrame, dimension: str) -> DataFrame:
    """The rows that carry a dimension's tag."""
    return chunks.where(F.array_contains("dimensions", dimension))


def labels_of(labels: DataFrame, docs: DataFrame, pipeline: str | None = None) -> DataFrame:
    """The labels of some documents (doc_id), of one pipeline if asked."""
    rows = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows if pipeline is None else rows.where(F.col("pipeline") == pipeline)


def newest_first(rows: DataFrame, by: str, order: str, ident: str) -> DataFrame:
    """(rows, place): the rows of each key with their place, the newest first; ties by the identifier."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), F.desc(ident))).cast("long"))


def most_used(skills: DataFrame, dimension: str) -> DataFrame:
    """The skills of a dimension by their use, most used first."""
    return skills.where(F.col("dimension") == dimension).orderBy(F.desc("used_count"), "skill_id")


def rules_or_default(rules: DataFrame, default: DataFrame) -> DataFrame:
    """The stored rule sets, or the default ones where there are none."""
    return rules.unionByName(default.join(rules.limit(1).select(F.lit(True).alias("_any")), how="left_anti", on=F.lit(True)))


def versions_from(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """The version dimension from configuration entries; entries without a number are skipped, keys derived."""
    from tidemark.functions.citations import normalise_number

    rows = [(str(e["number"]), e.get("latest_year"), e.get("title"), e.get("status", "current"), e.get("superseded_by"), e.get("source", "config")) for e in entries if isinstance(e, dict) and e.get("number")]
    df = spark.createDataFrame(rows, "number_raw string, latest_year int, title string, status string, superseded_by string, source string")
    return df.select(normalise_number(F.col("number_raw")).alias("norm"), *df.columns)


def seeded(clauses: DataFrame, seed: DataFrame) -> DataFrame:
    """Clauses with the seed rows that they lack."""
    return clauses.unionByName(seed.join(clauses.select("clause_id"), "clause_id", "left_anti"))


def tagged(clauses: DataFrame, tag: str) -> DataFrame:
    """The clauses with a tag."""
    return clauses.where(F.array_contains("tags", tag))


def config(path: str, base: str | None = None) -> dict:
    """A JSON configuration; values that begin with ./ are paths below its folder."""
    file = Path(path)
    root = Path(base) if base else file.parent

    def expand(value):
        if isinstance(value, dict):
            return {k: expand(v) for k, v in value.items()}
        if isinstance(value, list):
            return [expand(v) for v in value]
        return str(root / value[2:]) if isinstance(value, str) and value.startswith("./") else value

    return expand(json.loads(file.read_text(encoding="utf-8")))


def result_files(spark: SparkSession, folder: str, suffix: str = "_audit.json") -> DataFrame:
    """(task, path, result): the first result file of each task folder below `folder`, as JSON text."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
    rows = files.select(F.col("value").alias("result"), F.col("_metadata.file_path").alias("path")).withColumn("task", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return rows.groupBy("task").agg(F.min_by("result", "path").alias("result"), F.min("path").alias("path"))


def import_sections(sections: DataFrame, present: DataFrame, source: str = "source", embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sections (source, pos, title, content) with ids, neighbours and vectors; sources already present are skipped."""
    from tidemark.functions.text import zero_padded

    fresh = sections.join(present.select(source).distinct(), source, "left_anti")
    ordered = Window.partitionBy(source).orderBy("pos")
    safe = F.substring(F.regexp_replace(source, "[^A-Za-z0-9一-鿿]", "_"), 1, 30)
    rows = fresh.withColumn("chunk_id", F.concat(safe, F.lit("_"), zero_padded((F.row_number().over(ordered) - 1).cast("string"), 4)))
    rows = rows.withColumns({"prev_id": F.lag("chunk_id").over(ordered), "next_id": F.lead("chunk_id").over(ordered)})
    return rows if embed is None else rows.withColumn("vector", embed(F.concat_ws("\n", "title", "content")))


def import_counts(catalogue: DataFrame, sections: DataFrame, present: DataFrame, source: str = "source") -> DataFrame:
    """(source, n): how many sections an import adds; 0 for a source without any, -1 for one that is there."""
    counted = sections.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    there = present.select(source).distinct().withColumn("_there", F.lit(True))
    rows = catalogue.select(source).join(counted, source, "left").join(there, source, "left")
    return rows.select(source, F.when(F.col("_there"), -1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"))


def task_changes(tasks: DataFrame, changes: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks after inserts, updates and deletions; of several changes of a task the last one (`version`) counts."""
    last = store.upsert(changes.limit(0), changes, [key], "version")
    kept = tasks.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("op <> 'delete'").select(tasks.columns))


def rule_changes(rules: DataFrame, upserts: DataFrame, deleted: DataFrame, default: str = "default") -> DataFrame:
    """Rule sets after upserts and deletions; the default one is never deleted."""
    merged = store.upsert(rules.withColumn("_v", F.lit(0)), upserts.withColumn("_v", F.lit(1)), ["rule_id"], "_v").drop("_v")
    return merged.join(deleted.where(F.col("rule_id") != default).select("rule_id"), "rule_id", "left_anti")


def export_row(chunks: DataFrame, nested: list[str]) -> DataFrame:
    """Chunks with nested columns as JSON text, as a flat store holds them."""
    return chunks.withColumns({c: F.to_json(c) for c in nested})


def import_row(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Flat rows with the JSON columns read back by their types; what does not parse is null."""
    return rows.withColumns({c: F.from_json(c, kind) for c, kind in kinds.items()})


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Rows with every column of the defaults, filled where it is missing or null."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()})
