"""From ordered blocks to section-aware chunks.

Blocks have doc_id, pos, block_type (heading, paragraph, table, image), text, heading_level and
table_rows. Only the paths of headings depend on a chain of parents; they are folded document by
document over the headings alone. Everything else is windows and array functions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.lexicons import PSEUDO_HEADING_MAX, PSEUDO_HEADINGS
from tidemark.operators.sequence import running

MAX_TOKENS, INLINE_ROWS, SUMMARY_ROWS = 800, 10, 4
_NUMBER = re.compile(r"^(\d+(?:\.\d+){0,4})\.?\s+")
_APPENDIX = re.compile(r"^附\s*[录件]\s*([A-Za-z0-9一二三四五六七八九十]+)")


def pseudo_heading_level(text: Column) -> Column:
    """The level of a paragraph that reads like a heading, else null."""
    bare = F.trim(text)
    level = tx.first_match(bare, [(bare.rlike("(?U)" + p), F.lit(n)) for p, n in PSEUDO_HEADINGS])
    return F.when(F.length(bare).between(1, PSEUDO_HEADING_MAX), level)


def style_level(style: Column) -> Column:
    """The level in a style's name, else null."""
    return F.nullif(F.regexp_extract(style, r"(?i)heading\s*(\d+)", 1), F.lit("")).cast("int")


def table_text(rows: Column) -> Column:
    """Rows of cells as lines of a Markdown table."""
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n")


def own_path(title: str) -> str | None:
    """The path that a heading's own number or appendix letter gives."""
    bare = title.replace("*", "").strip()
    if m := _NUMBER.match(bare):
        return m[1]
    if m := _APPENDIX.match(bare):
        return f"APP_{m[1]}"
    return None


def heading_paths(headings: DataFrame) -> DataFrame:
    """(doc_id, pos, path, title): a heading without a number hangs on the last one above its level."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        above: dict[int, str] = {}
        paths = []
        for level, title in group.sort_values("pos")[["heading_level", "text"]].itertuples(index=False):
            level = 1 if pd.isna(level) else int(level)
            above = {k: v for k, v in above.items() if k < level}
            parent = above[max(above)] if above else ""
            above[level] = own_path(title) or (f"{parent}.x" if parent else f"H{level}_{title.replace('*', '').strip()[:8]}")
            paths.append(above[level])
        out = group.sort_values("pos")
        return pd.DataFrame({"doc_id": out.doc_id, "pos": out.pos, "path": paths, "title": out.text})

    return headings.select("doc_id", "pos", "heading_level", "text").groupBy("doc_id").applyInPandas(fold, "doc_id string, pos int, path string, title string")


def flush_groups(costs: Column, limit: int) -> Column:
    """Group numbers for costs in order: a group closes with the cost that brings it to the limit."""
    state = F.struct(F.lit(0).cast("double").alias("sum"), F.lit(0).alias("group"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, cost: Column) -> Column:
        total = acc["sum"] + cost
        full = total >= limit
        return F.struct(
            F.when(full, F.lit(0).cast("double")).otherwise(total).alias("sum"),
            F.when(full, acc["group"] + 1).otherwise(acc["group"]).alias("group"),
            F.array_append(acc["out"], acc["group"]).alias("out"))

    return F.aggregate(costs, state, step, lambda acc: acc["out"])


def chunk_blocks(blocks: DataFrame, max_tokens: int = MAX_TOKENS, inline_rows: int = INLINE_ROWS) -> DataFrame:
    """(doc_id, chunk_id, chunk_type, section_path, title, content, pos, cross_refs, parent_id) in order of pos."""
    paths = heading_paths(blocks.where("block_type = 'heading'"))
    placed = blocks.join(paths, ["doc_id", "pos"], "left")
    order = running(["doc_id"], ["pos"])
    placed = placed.withColumns({
        "section_path": F.coalesce(F.last("path", True).over(order), F.lit("")),
        "title": F.coalesce(F.last("title", True).over(order), F.lit("")),
        # paragraphs between two blocks of another kind are one run
        "run": F.sum((F.col("block_type") != "paragraph").cast("int")).over(order),
    })
    base = ["doc_id", "section_path", "title", "pos"]
    paragraphs = placed.where("block_type = 'paragraph'").groupBy("doc_id", "section_path", "title", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("ps"))
    # the token estimate counts the newlines that join the paragraphs, so each one costs a character more
    cost = F.transform("ps", lambda p: (F.length(p["text"]) + 1).cast("double"))
    limit = next(n for n in range(max_tokens * 2) if int((n - 1) * tx.TOKEN_RATIO) >= max_tokens)
    grouped = paragraphs.select("doc_id", "section_path", "title", F.explode(F.arrays_zip("ps", flush_groups(cost, limit).alias("g"))).alias("z"), "run")
    texts = grouped.groupBy("doc_id", "section_path", "title", "run", F.col("z.g").alias("g")).agg(F.min("z.ps.pos").alias("pos"), F.array_sort(F.collect_list("z.ps")).alias("ps"))
    texts = texts.select(*base, F.lit("text").alias("chunk_type"), F.lit("text").alias("kind"), F.array_join(F.transform("ps", lambda p: p["text"]), "\n").alias("content")).where("trim(content) <> ''")
    same = lambda t, k: placed.where(f"block_type = '{k}'").select(*base, F.lit(t).alias("chunk_type"), F.lit(k).alias("kind"), F.col("text").alias("content"))
    n = F.size("table_rows")
    summary = F.concat(table_text(F.slice("table_rows", 1, SUMMARY_ROWS)), F.lit("\n... 共 "), n.cast("string"), F.lit(" 行"))
    big = n > inline_rows
    tables = placed.where("block_type = 'table'").select(
        *base, F.lit("table_summary").alias("chunk_type"), F.lit("table").alias("kind"), F.when(big, summary).otherwise(F.col("text")).alias("content"), big.alias("big"), F.col("text").alias("full"))
    rows = texts.unionByName(same("heading", "heading")).unionByName(same("image", "image")).unionByName(tables, allowMissingColumns=True)
    number = F.row_number().over(Window.partitionBy("doc_id", "section_path", "kind").orderBy("pos"))
    root = F.when(F.col("section_path") == "", "ROOT").otherwise(F.col("section_path"))
    rows = rows.withColumn("chunk_id", F.concat_ws("__", "doc_id", root, "kind", tx.zero_padded(number.cast("string"), 3)))
    is_big = F.coalesce("big", F.lit(False))
    full_id = F.concat("chunk_id", F.lit("__full"))
    chunks = rows.select("doc_id", "chunk_id", "chunk_type", "section_path", "title", "content", "pos",
                         F.when(is_big, F.array(full_id)).otherwise(F.array().cast("array<string>")).alias("cross_refs"), F.lit(None).cast("string").alias("parent_id"))
    whole = rows.where(is_big).select("doc_id", full_id.alias("chunk_id"), F.lit("table_full").alias("chunk_type"), "section_path", "title", F.col("full").alias("content"), "pos",
                                      F.array("chunk_id").alias("cross_refs"), F.col("chunk_id").alias("parent_id"))
    return chunks.unionByName(whole)


def markdown_sections(docs: DataFrame, key: list[str], text: str, skip: str = r"目\s*[录次]", least: int = 60, most: int = 2000) -> DataFrame:
    """(key, section, level, title, chapter, content): Markdown split at headings, tables of contents left out."""
    lines = docs.select(*key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    mark = F.regexp_extract("line", r"^(#{1,4}) ", 1)
    lines = lines.withColumns({"level": F.length(mark), "head": F.when(mark != "", F.trim(F.regexp_replace("line", r"^#{1,4} ", "")))})
    order = running(key, ["pos"])
    lines = lines.withColumns({"section": F.sum((F.col("level") > 0).cast("int")).over(order), "chapter": F.last(F.when(F.col("level") == 1, F.col("head")), True).over(order)})
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    sections = lines.groupBy(*key, "section").agg(F.max("level").alias("level"), F.max("head").alias("title"), F.max("chapter").alias("chapter"), F.trim(body).alias("content"))
    kept = sections.where((F.col("section") > 0) & ~F.col("title").rlike(skip) & (F.length("content") >= least))
    return kept.withColumn("content", F.substring("content", 1, most))
