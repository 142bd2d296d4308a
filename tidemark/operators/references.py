"""References of documents: appendices, tables, figures and standards, checked against versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.citations import citations, unlisted, version_findings
from tidemark.functions.text import any_of
from tidemark.lexicons import REFERENCE_FAMILIES, REFERENCE_PATTERNS, REFERENCE_TITLES, STANDARD_REFERENCE

_YEAR = r"[—\-](?:19|20)\d{2}$"


def normalised_reference(raw: Column) -> Column:
    """A reference as a key: without year, spaces and, behind a known family, dots; upper case."""
    bare = F.upper(F.regexp_replace(F.trim(F.regexp_replace(F.trim(raw), _YEAR, "")), r"(?U)\s+", ""))
    out = bare
    for family in sorted(REFERENCE_FAMILIES, key=len):  # the longest family is tested first
        rest = F.replace(F.substring(bare, F.lit(len(family) + 1), F.length(bare)), F.lit("."), F.lit(""))
        out = F.when(bare.startswith(family), F.concat(F.lit(REFERENCE_FAMILIES[family]), rest)).otherwise(out)
    return out


def references(chunks: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, tag, raw, year): references of each row's title and content, by kind."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    rows = chunks.select("doc_id", "pos", text.alias("text"))
    parts = []
    for kind, pattern in REFERENCE_PATTERNS.items():
        tags = rows.select("doc_id", "pos", F.explode(F.regexp_extract_all("text", F.lit("(?U)" + pattern), F.lit(1))).alias("tag"))
        parts.append(tags.select("doc_id", "pos", F.lit(kind).alias("kind"), (F.upper("tag") if kind == "appendix" else F.col("tag")).alias("tag"), F.col("tag").alias("raw"), F.lit(None).cast("int").alias("year")))
    raw = rows.select("doc_id", "pos", F.explode(F.regexp_extract_all("text", F.lit("(?U)" + STANDARD_REFERENCE), F.lit(0))).alias("raw")).withColumn("raw", F.trim("raw"))
    year = F.nullif(F.regexp_extract("raw", r"[-—]\s*(\d{4})$", 1), F.lit("")).cast("int")
    parts.append(raw.select("doc_id", "pos", F.lit("standard").alias("kind"), normalised_reference(F.col("raw")).alias("tag"), "raw", year.alias("year")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def reference_summary(chunks: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, tag, n, defined): how often each reference occurs, and whether its appendix is there.

    anchors: (doc_id, label) of the appendices of the documents. Other kinds have no `defined`.
    """
    counted = references(chunks).groupBy("doc_id", "kind", "tag").agg(F.count(F.lit(1)).alias("n"))
    if anchors is None:
        return counted.withColumn("defined", F.lit(None).cast("boolean"))
    known = anchors.select("doc_id", F.col("label").alias("tag"), F.lit("appendix").alias("kind"), F.lit(True).alias("_d")).distinct()
    rows = counted.join(known, ["doc_id", "kind", "tag"], "left")
    return rows.withColumn("defined", F.when(F.col("kind") == "appendix", F.col("_d").isNotNull())).drop("_d")


def validated(refs: DataFrame, versions: DataFrame, key: list[str]) -> DataFrame:
    """(key, tag, found, status, latest_year, superseded_by): each different reference against the versions (norm, ...)."""
    each = refs.select(*key, "tag").distinct()
    known = versions.select(F.col("norm").alias("tag"), "latest_year", "status", "superseded_by", F.lit(True).alias("found"))
    rows = each.join(known, "tag", "left")
    return rows.select(*key, "tag", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("status", F.lit("unknown")).alias("status"), "latest_year", "superseded_by")


def reference_section(chunks: DataFrame) -> DataFrame:
    """The rows of each document's section of references: from a title that names it to the next titled row."""
    title = F.trim(F.coalesce("title", F.lit("")))
    opens = any_of(title, REFERENCE_TITLES)
    ordered = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a part begins at every titled row; the rows of the parts that are named before the first other part count
    rows = chunks.withColumns({"_opens": opens, "_titled": title != ""})
    rows = rows.withColumn("_started", F.max(F.col("_opens").cast("int")).over(ordered))
    rows = rows.withColumn("_left", F.coalesce(F.max(F.when((F.col("_started") == 1) & F.col("_titled") & ~F.col("_opens"), 1)).over(ordered), F.lit(0)))
    return rows.where("_started = 1 and _left = 0").drop("_opens", "_titled", "_started", "_left")


def version_check(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """(doc_id, norm, raw, year, kind, severity, description, evidence): all version findings of the documents."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), "\n")
    body = citations(chunks.groupBy("doc_id").agg(text.alias("text")), ["doc_id"], "text")
    listed = citations(reference_section(chunks).groupBy("doc_id").agg(text.alias("text")), ["doc_id"], "text")
    known = version_findings(body, versions, ["doc_id"])
    missing = unlisted(body, listed, ["doc_id"]).join(versions.select("norm"), "norm", "left_semi")
    missing = missing.select("doc_id", "norm", "raw", "year", F.lit("unlisted").alias("kind"), F.lit("medium").alias("severity"))
    rows = known.unionByName(missing)
    contexts = body.select("doc_id", "norm", F.col("year").alias("_y"), "context")
    rows = rows.join(contexts, (rows["doc_id"] == contexts["doc_id"]) & (rows["norm"] == contexts["norm"]) & rows["year"].eqNullSafe(contexts["_y"]), "left").select(rows["*"], "context")
    rows = rows.join(versions.select("norm", "latest_year"), "norm", "left")
    told = (
        F.when(F.col("kind") == "outdated", F.format_string("引用非最新标准：%s（文档年份 %s，库中最新 %s）", "raw", F.coalesce(F.col("year").cast("string"), F.lit("None")), F.coalesce(F.col("latest_year").cast("string"), F.lit("None"))))
        .when(F.col("kind") == "unlisted", F.concat(F.lit("正文引用标准未列入引用清单："), "raw")).otherwise(F.concat(F.lit("标准编号无法追溯（库中不存在）："), "raw")))
    return rows.select("doc_id", "norm", "raw", "year", "kind", "severity", told.alias("description"), F.substring("context", 1, 200).alias("evidence"))


def version_summary(findings: DataFrame) -> DataFrame:
    """(doc_id, outdated, unlisted, untraceable, total): the numbers by kind."""
    names = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("raw")))).alias(kind)
    return findings.groupBy("doc_id").agg(names("outdated"), names("unlisted"), names("untraceable"), F.count(F.lit(1)).alias("total"))


def with_version_findings(results: DataFrame, findings: DataFrame) -> DataFrame:
    """Results (doc_id, verdict, score, findings) with the version findings added.

    A pass becomes partial with a score of 9 at most and a review where one of them is high.
    """
    found = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("severity", "description", "evidence", F.concat(F.lit("STDLIB:"), F.upper("kind")).alias("rule_id")))).alias("_f"))
    rows = results.join(found, "doc_id", "left")
    worse = F.coalesce(F.exists("_f", lambda f: f["severity"] == "high"), F.lit(False)) & (F.col("verdict") == "pass")
    return rows.withColumns({
        "score": F.when(worse, F.least("score", F.lit(9))).otherwise(F.col("score")), "need_review": worse, "verdict": F.when(worse, "partial").otherwise(F.col("verdict")),
        "findings": F.when(F.col("_f").isNull(), F.col("findings")).otherwise(F.concat("findings", "_f")),
    }).drop("_f")
