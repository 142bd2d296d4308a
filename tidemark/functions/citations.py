"""Citations of standards in text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.lexicons import STANDARD_FAMILIES

_YEAR = r"[—\-]((?:19|20)\d{2})$"
_FAMILIES = sorted(STANDARD_FAMILIES, key=len, reverse=True)
# (?U) lets \s cover every white space, as the reference's patterns do
CITATION = r"(?U)(?:" + "|".join(re.escape(f) for f in _FAMILIES) + r")\s*[A-Z]?[0-9]+(?:\.[0-9]+)*(?:[—\-](?:19|20)[0-9]{2})?"
CONTEXT = 40


def normalise_number(raw: Column) -> Column:
    """A standard's number without year and spaces, upper case, its family in short form; dots stay."""
    bare = F.trim(F.regexp_replace(F.trim(raw), _YEAR, ""))
    out = F.upper(F.regexp_replace(bare, r"\s+", ""))
    for family in reversed(_FAMILIES):  # the longest family is tested first
        prefix = r"(?i)^" + re.escape(family) + r"\s*"
        rest = F.upper(F.regexp_replace(F.regexp_replace(bare, prefix, ""), r"\s+", ""))
        out = F.when(bare.rlike(prefix), F.concat(F.lit(STANDARD_FAMILIES[family]), rest)).otherwise(out)
    return out


def cited_year(raw: Column) -> Column:
    """The year at the end of a number, or null."""
    return F.nullif(F.regexp_extract(F.trim(raw), _YEAR, 1), F.lit("")).cast("int")


def citations(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, pos, raw, norm, year, context): each number and year once a text, at its first place."""
    found = docs.select(*key, text, F.posexplode(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))).alias("pos", "raw"))
    rows = found.select(*key, text, "pos", F.trim("raw").alias("raw"), normalise_number(F.col("raw")).alias("norm"), cited_year(F.col("raw")).alias("year"))
    first = rows.groupBy(*key, "norm", "year").agg(F.min_by(F.struct("pos", "raw", text), "pos").alias("f"))
    at = F.instr(F.col(f"f.{text}"), F.col("f.raw"))
    around = F.substring(F.col(f"f.{text}"), F.greatest(at - CONTEXT, F.lit(1)), F.least(at - 1, F.lit(CONTEXT)) + F.length("f.raw") + CONTEXT)
    return first.select(*key, "f.pos", "f.raw", "norm", "year", F.trim(F.translate(around, "\n", " ")).alias("context"))


def version_findings(cited: DataFrame, versions: DataFrame, key: list[str]) -> DataFrame:
    """Citations against versions (norm, latest_year, superseded_by): superseded or older ones, unknown ones."""
    joined = cited.join(versions.select("norm", "latest_year", "superseded_by", F.lit(True).alias("_known")), "norm", "left")
    older = F.col("year") < F.col("latest_year")
    kind = F.when(F.col("_known").isNull(), "untraceable").when(F.col("superseded_by").isNotNull() | older, "outdated")
    severity = F.when(F.col("_known").isNull(), "low").when(F.col("superseded_by").isNotNull(), "high").when(older, "medium")
    return joined.select(*key, "norm", "raw", "year", kind.alias("kind"), severity.alias("severity")).where("kind IS NOT NULL")


def unlisted(body: DataFrame, listed: DataFrame, key: list[str]) -> DataFrame:
    """Citations of the body that the reference section lacks, where a document has such a section."""
    return body.join(listed.select(*key).distinct(), key, "left_semi").join(listed.select(*key, "norm"), [*key, "norm"], "left_anti")
