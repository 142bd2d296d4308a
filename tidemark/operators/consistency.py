"""Consistency of plans: leaders, codes, excerpts around words, required standards and blocks, emergency steps."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions import text as tx
from tidemark.lexicons import (
    APPENDIX_HINTS, EMERGENCY_WORDS, LEADER_NEEDLES, LEADER_PATTERNS, LEADER_STOP_WORDS, NUMBERED_STEP, NUMBER_UNITS, PIPELINE_CODE, RELATED_STANDARDS,
    REQUIRED_STANDARD, ROLE_NUMBERS, STAKE, THREE_BLOCKS,
)
from tidemark.operators import folds


def document_text(chunks: DataFrame, parts: tuple[str, ...] = ("title", "content"), joiner: str = "\n") -> DataFrame:
    """(doc_id, text): the parts of a document's rows in order, blank ones left out."""
    pieces = F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda x: x != "")
    rows = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", pieces.alias("p")))).alias("r"))
    return rows.select("doc_id", F.array_join(F.flatten(F.transform("r", lambda x: x["p"])), joiner).alias("text"))


def leaders(text: Column) -> Column:
    """Names of section leaders by any of the patterns, each once, in the order of patterns and places."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(1)) for p in LEADER_PATTERNS]))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*LEADER_STOP_WORDS)))


def merged_names(first: Column, second: Column) -> Column:
    """The names of both lists, each once, those of the first in front."""
    return F.array_distinct(F.concat(first, second))


def pipeline_codes(text: Column, doc_id: Column | None = None) -> Column:
    """Codes in a text in upper case, each once; with the one that the document's id holds."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PIPELINE_CODE), F.lit(1)), F.upper)
    if doc_id is not None:
        found = F.concat(found, F.array_compact(F.array(code_of_id(doc_id))))
    return F.array_distinct(found)


def code_of_id(doc_id: Column) -> Column:
    """The code in a document's id, underscores left out; null without one."""
    return F.nullif(F.regexp_extract(F.upper(F.replace(doc_id, F.lit("_"), F.lit(""))), PIPELINE_CODE, 1), F.lit(""))


def stakes(text: Column) -> Column:
    """Stake numbers in a text, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({STAKE})"), F.lit(1)))


def context_results(texts: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(doc_id, leaders, codes, stakes, findings, verdict, score, confidence) of documents (doc_id, text).

    `named` has more leaders by document (doc_id, names), as a model finds them.
    """
    rows = texts.withColumn("leaders", leaders(F.col("text")))
    if named is not None:
        rows = rows.join(named, "doc_id", "left").withColumn("leaders", merged_names(F.col("leaders"), F.coalesce("names", F.array().cast("array<string>")))).drop("names")
    rows = rows.withColumns({"codes": pipeline_codes(F.col("text"), F.col("doc_id").cast("string")), "stakes": stakes(F.col("text"))})
    basic = F.col("text").contains("基本信息") | F.col("text").contains("高后果区基本情况")
    finding = lambda test, severity, rule: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule_id")))
    found = F.array_compact(F.array(
        finding(F.size("leaders") > 1, "medium", "L1.leader_inconsistent"),
        finding((F.size("leaders") == 0) & tx.any_of(F.col("text"), LEADER_NEEDLES), "low", "L1.leader_extract_uncertain"),
        finding(F.size("codes") > 1, "medium", "L1.pipeline_code_multiple"),
        finding(basic & F.col("text").contains("风险评价"), "low", "L1.manual_verify_basic_vs_risk_evaluation"),
    ))
    rows = rows.withColumn("findings", found)
    blank, high, some = F.trim("text") == "", F.exists("findings", lambda f: f["severity"] == "high"), F.size("findings") > 0
    ladder = [(blank, ("uncertain", 0, 15)), (high, ("fail", 4, 70)), (some, ("partial", 7, 75)), (F.lit(True), ("pass", 10, 85))]
    return rows.select("doc_id", "leaders", "codes", "stakes", "findings", *folds.ladder(ladder))


def excerpt(text: Column, words: list[str], before: int, after: int, budget: int) -> Column:
    """What lies around the words of a long text, overlapping pieces merged, up to a budget of characters.

    A text within the budget is taken whole; a longer one without any of the words is cut.
    """

    def starts(word: str) -> Column:
        pieces = F.split(text, _quoted(word), -1)
        lengths = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p) + len(word))
        return F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x) - len(word))

    found = F.flatten(F.array(*[F.when(text.contains(w), starts(w)).otherwise(F.array().cast("array<int>")) for w in words]))
    spans = F.array_sort(F.transform(found, lambda i: F.struct(F.greatest(i - before, F.lit(0)).alias("a"), F.least(i + after, F.length(text)).alias("b"))))
    none = F.array().cast("array<struct<a:int,b:int>>")
    joined = F.aggregate(spans, none, lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= s["a"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], s["b"]).alias("b")))),
    ).otherwise(F.concat(acc, F.array(s))))
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("out"))
    taken = F.aggregate(joined, start, lambda acc, s: F.struct(
        (acc["left"] - F.least(acc["left"], s["b"] - s["a"])).alias("left"),
        F.when(acc["left"] > 0, F.concat(acc["out"], F.array(F.substring(text, s["a"] + 1, F.least(acc["left"], s["b"] - s["a"]))))).otherwise(acc["out"]).alias("out"),
    ))
    return F.when(F.length(text) <= budget, text).when(F.size(found) == 0, F.substring(text, 1, budget)).otherwise(F.array_join(taken["out"], "\n...\n"))


def _quoted(word: str) -> str:
    return r"\Q" + word + r"\E"


def required_standard(texts: DataFrame, required: list[str] = REQUIRED_STANDARD, also: list[str] = RELATED_STANDARDS) -> DataFrame:
    """(doc_id, cited, related, verdict, score, confidence): the standard that a plan must cite in any spelling, and those it may."""
    related = F.array_compact(F.array(*[F.when(F.col("text").contains(w), F.lit(w)) for w in also]))
    rows = texts.select("doc_id", tx.any_of(F.col("text"), required).alias("cited"), related.alias("related"), (F.trim("text") == "").alias("blank"))
    return rows.select("doc_id", "cited", "related", *folds.ladder([(F.col("blank"), ("uncertain", 0, 15)), (~F.col("cited"), ("fail", 4, 85)), (F.lit(True), ("pass", 12, 90))]))


def three_blocks(texts: DataFrame, blocks: dict[str, list[str]] | None = None, size: int = 800) -> DataFrame:
    """(doc_id, missing, snippets, verdict, score, confidence): the blocks that a plan must describe, with what begins at each."""
    blocks = blocks or THREE_BLOCKS
    first = lambda words: tx.first_match(F.col("text"), [(F.col("text").contains(w), F.substring(F.col("text"), F.instr("text", w), F.lit(size))) for w in words])
    rows = texts.select("doc_id", (F.trim("text") == "").alias("blank"), F.array(*[F.struct(F.lit(b).alias("block"), first(words).alias("text")) for b, words in blocks.items()]).alias("all"))
    rows = rows.withColumns({"missing": F.transform(F.filter("all", lambda b: b["text"].isNull()), lambda b: b["block"]), "snippets": F.filter("all", lambda b: b["text"].isNotNull())})
    share = F.size("snippets") / len(blocks)
    ladder = [(F.col("blank"), ("uncertain", 0, 15)), (F.size("snippets") == 0, ("fail", 3, 85)), (share == 1, ("pass", 10, 75)), (share >= 0.66, ("partial", 7, 70)), (F.lit(True), ("fail", 4, 75))]
    return rows.select("doc_id", "missing", "snippets", *folds.ladder(ladder))


def is_appendix(section_path: Column, text: Column) -> Column:
    """Whether a row belongs to an appendix or a response card, by its section or its words."""
    path = F.coalesce(section_path, F.lit(""))
    return tx.any_of(path, APPENDIX_HINTS) | F.upper(path).startswith("APP") | tx.any_of(F.coalesce(text, F.lit("")), APPENDIX_HINTS)


def emergency_sides(chunks: DataFrame) -> DataFrame:
    """(doc_id, relevant, missing_side, main, appendix): the emergency rows of a document by side.

    `relevant` is false where no text names an emergency; a side without rows is missing.
    """
    rows = chunks.where(F.lower("chunk_type").isin("text", "table_summary") & (F.trim("content") != "")).select(
        "doc_id", "pos", "content", is_appendix(F.col("section_path"), F.col("content")).alias("side"), tx.any_of(F.col("content"), EMERGENCY_WORDS).alias("hit"))
    pick = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("hit") & (F.col("side") == side), F.struct("pos", "content")))), lambda x: x["content"])
    sides = chunks.select("doc_id").distinct().join(rows.groupBy("doc_id").agg(F.bool_or("hit").alias("hit"), pick(False).alias("main"), pick(True).alias("appendix")), "doc_id", "left")
    none = F.array().cast("array<string>")
    sides = sides.select("doc_id", F.coalesce("hit", F.lit(False)).alias("relevant"), F.coalesce("main", none).alias("main"), F.coalesce("appendix", none).alias("appendix"))
    return sides.select("doc_id", "relevant", missing_side(F.size("main") > 0, F.size("appendix") > 0).alias("missing_side"), "main", "appendix")


def missing_side(has_main: Column, has_appendix: Column) -> Column:
    return F.when(~has_main & ~has_appendix, "both").when(~has_main, "main").when(~has_appendix, "appendix").otherwise("none")


def clean_steps(steps: Column) -> Column:
    """Steps trimmed, blank ones left out; null is no steps."""
    return F.filter(F.transform(F.coalesce(steps, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def numbered_steps(text: Column) -> Column:
    """The numbered steps of a text, each up to 100 characters."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?U)" + NUMBERED_STEP), F.lit(1)), lambda x: F.substring(F.trim(x), 1, 100))


@F.pandas_udf(DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two lists are in their order, between 0 and 1."""
    return pd.Series([difflib.SequenceMatcher(None, list(x), list(y)).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def compared_steps(pairs: DataFrame, main: str, appendix: str) -> DataFrame:
    """pairs with similarity, consistent, missing_in_main and extra_in_main of two lists of steps."""
    both = (F.size(main) == 0) & (F.size(appendix) == 0)
    likeness = F.when(both, 1.0).otherwise(sequence_similarity(F.col(main), F.col(appendix)))
    rows = pairs.withColumn("_s", likeness)
    return rows.withColumns({
        "similarity": F.bround("_s", 3), "consistent": F.col("_s") >= 0.7, "missing_in_main": F.array_except(appendix, main), "extra_in_main": F.array_except(main, appendix),
    }).drop("_s")


def role_numbers(text: Column) -> Column:
    """The first number of each role in a text, as a map; roles without one are left out."""
    found = [F.struct(F.lit(k).alias("key"), F.nullif(F.regexp_extract(text, "(?U)" + p, 1), F.lit("")).cast("double").alias("value")) for k, p in ROLE_NUMBERS.items()]
    return F.map_from_entries(F.filter(F.array(*found), lambda e: e["value"].isNotNull()))


def numbers_with_units(text: Column, units: list[str] | None = None) -> Column:
    """The numbers before each unit, as a map of lists; units without one are left out."""
    entries = [F.struct(F.lit(u).alias("key"), F.transform(F.regexp_extract_all(text, F.lit(rf"([0-9]+(?:\.[0-9]+)?)[ \t]*{u}"), F.lit(1)), lambda x: x.cast("double")).alias("value")) for u in units or NUMBER_UNITS]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))

