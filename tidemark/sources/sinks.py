"""Sinks of results: JSON and Markdown files, comments by paragraph, trace events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.similarity import best_match, counts


def result_json(df: DataFrame, name: str = "json") -> DataFrame:
    """df with all its columns as one JSON text."""
    return df.withColumn(name, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": "true"}))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object for each row, in as many files as there are partitions."""
    df.write.mode("overwrite").json(path)


def write_reports(reports: DataFrame, folder: str) -> None:
    """One text file for each document below folder/doc_id=..., from (doc_id, report)."""
    reports.select("doc_id", F.col("report").alias("value")).repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").text(folder)


def write_outputs(results: DataFrame, reports: DataFrame, folder: str) -> None:
    """The JSON and the Markdown of a run."""
    write_json(results, f"{folder}/json")
    write_reports(reports, f"{folder}/markdown")


def nearest_paragraph(paragraphs: list[str], anchor: str, section: str, fallback: int, low: list[str] | None = None) -> int:
    """The place of the paragraph that a finding is about.

    The first that names its section; else the first that holds its anchor; else the one most like it; else
    the place that the finding gives. `low` has the paragraphs' first 200 characters in lower case.
    """
    if not paragraphs:
        return 0
    last = len(paragraphs) - 1
    if section:
        short = section.rsplit(".", 1)[-1]
        for i, text in enumerate(paragraphs):
            if section in text or short in text:
                return i
    wanted = anchor.lower()[:80]
    if wanted:
        low = low if low is not None else [t.lower()[:200] for t in paragraphs]
        for i, text in enumerate(low):
            if wanted in text:
                return i
        parts = [t[: len(wanted) + 40] for t in low]
        place, _, _ = best_match(wanted, parts, counts(parts))
        if place >= 0:
            return place
    return max(0, min(fallback, last))


def placed_comments(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Findings (doc_id, anchor_text, section_path, paragraph_index, ...) with the paragraph for their comment.

    Both sides meet by document, so that its paragraphs (doc_id, pos, text) are read once for all its findings.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in findings.schema) + ", paragraph int"

    def place(mine: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        paragraphs = texts.sort_values("pos")["text"].fillna("").tolist()
        low = [t.lower()[:200] for t in paragraphs]
        plain = lambda x: "" if x is None or x != x else x
        rows = zip(mine["anchor_text"], mine["section_path"], mine["paragraph_index"].fillna(0), strict=True)
        found = [nearest_paragraph(paragraphs, plain(a), plain(s), int(f), low) for a, s, f in rows]
        return mine.assign(paragraph=pd.array(found, dtype="int32"))

    return findings.groupBy("doc_id").cogroup(blocks.select("doc_id", "pos", "text").groupBy("doc_id")).applyInPandas(place, ddl)


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of trace events appended to Parquet files, all that is there and then stopped."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

