"""Results in the form of the contest: types of problems, their basis, another fold of verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.lexicons import AUDIT_DIMENSIONS, PROBLEM_BY_DESCRIPTION, PROBLEM_BY_RULE, PROBLEM_OTHER, RULE_BASIS, RULE_BASIS_OTHER
from tidemark.operators import folds


def looked_up(key: Column, table: dict[str, str], default: Column) -> Column:
    """The value of a fixed table, or the default."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), default)


def problem_type(rule_id: Column, description: Column, given: Column | None = None, by_rule=PROBLEM_BY_RULE, by_description=PROBLEM_BY_DESCRIPTION, other: str = PROBLEM_OTHER) -> Column:
    """The type that is given, or else the first that the words of the rule id, then of the description, tell."""
    rule, text = F.lower(F.coalesce(rule_id, F.lit(""))), F.coalesce(description, F.lit(""))
    cases = [(tx.any_of(rule, words), F.lit(name)) for words, name in by_rule] + [(tx.any_of(text, words), F.lit(name)) for words, name in by_description]
    found = tx.first_match(rule, cases, F.lit(other))
    return found if given is None else F.coalesce(F.nullif(given, F.lit("")), found)


def rule_basis(dimension: Column, given: Column | None = None) -> Column:
    """The basis that is given, or the dimension's own."""
    found = looked_up(dimension, RULE_BASIS, F.lit(RULE_BASIS_OTHER))
    return found if given is None else F.coalesce(F.nullif(given, F.lit("")), found)


def is_problem(verdict: Column, n_findings: Column) -> Column:
    """Pass is none, fail and partial are one, an uncertain verdict is one where there are findings."""
    return F.when(verdict == "pass", False).when(verdict.isin("fail", "partial"), True).otherwise(n_findings > 0)


def contest_findings(results: DataFrame) -> DataFrame:
    """One row for each finding of results (doc_id, dimension, verdict, findings array<struct>).

    Findings carry severity, description, evidence, anchor_text, rule_id, problem_type, rule_basis and
    correction_suggestion, any of them null.
    """
    rows = results.select("doc_id", "dimension", "verdict", F.size("findings").alias("n"), F.posexplode("findings").alias("pos", "f"))
    text = lambda name: F.coalesce(F.nullif(F.col(f"f.{name}"), F.lit("")), F.lit(""))
    return rows.select(
        "doc_id", "pos", looked_up(F.col("dimension"), AUDIT_DIMENSIONS, F.col("dimension")).alias("audit_dimension"), F.col("dimension").alias("audit_subtype"),
        is_problem(F.col("verdict"), F.col("n")).alias("is_problem"), problem_type(F.col("f.rule_id"), F.col("f.description"), F.col("f.problem_type")).alias("problem_type"),
        F.coalesce("f.severity", F.lit("medium")).alias("severity"), F.coalesce(F.nullif(F.col("f.evidence"), F.lit("")), text("anchor_text")).alias("evidence"),
        rule_basis(F.col("dimension"), F.col("f.rule_basis")).alias("rule_basis"), text("correction_suggestion").alias("correction_suggestion"),
    )


def strict_overall(verdict: str = "verdict") -> Column:
    """Another roll-up of dimension verdicts: any fail, any partial, all pass, else uncertain."""
    v = F.col(verdict)
    return F.when(F.bool_or(v == "fail"), "fail").when(F.bool_or(v == "partial"), "partial").when(F.bool_and(v == "pass"), "pass").otherwise("uncertain").alias("overall_verdict")


def contest_summary(results: DataFrame) -> DataFrame:
    """(doc_id, overall_verdict, n_high, n_medium, n_low, n_problems, has_problems, need_review) of each document."""
    rolled = results.groupBy("doc_id").agg(strict_overall(), F.coalesce(F.bool_or("need_human_review"), F.lit(False)).alias("need_review"))
    count = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    found = contest_findings(results).groupBy("doc_id").agg(count("high"), count("medium"), count("low"), F.count_if("is_problem").alias("n_problems"))
    joined = rolled.join(found, "doc_id", "left").na.fill(0, ["n_high", "n_medium", "n_low", "n_problems"])
    return joined.withColumn("has_problems", F.col("n_problems") > 0)


def overall_opinion(opinions: DataFrame) -> DataFrame:
    """(doc_id, n_fail, n_partial, n, opinion): one sentence from the verdicts of a document's opinions."""
    rows = opinions.groupBy("doc_id").agg(F.count_if(F.col("verdict") == "fail").alias("n_fail"), F.count_if(F.col("verdict") == "partial").alias("n_partial"), F.count(F.lit(1)).alias("n"))
    sentence = (
        F.when(F.col("n_fail") > 0, F.format_string("文档存在 %d 项严重问题，需要重点整改后方可使用。", "n_fail"))
        .when(F.col("n_partial") > 0, F.format_string("文档存在 %d 项待改进之处，建议按建议优化后可投入使用。", "n_partial"))
        .otherwise("文档基本符合要求，仅有个别细节需注意。")
    )
    return rows.withColumn("opinion", sentence)


def opinions(results: DataFrame) -> DataFrame:
    """(doc_id, dimension, verdict, opinion) by rule, for results that no model has worded: the findings by severity."""
    order = F.transform(F.array_sort(F.transform("findings", lambda f, i: F.struct(F.when(f["severity"] == "high", 0).when(f["severity"] == "medium", 1).otherwise(2).alias("o"), i.alias("i"), f["description"].alias("d")))), lambda x: x["d"])
    return results.select("doc_id", "dimension", "verdict", F.array_join(order, "; ").alias("opinion"))


def sparse_json(finding: Column, fields: list[str]) -> Column:
    """A finding as JSON without its empty fields."""
    return F.to_json(F.struct(*[F.nullif(finding[f].cast("string"), F.lit("")).alias(f) for f in fields]))


def location(finding: Column, dimension: Column) -> Column:
    """Where a finding points: its page by paragraph, and what to highlight."""
    shown = F.coalesce(F.nullif(F.substring(finding["anchor_text"], 1, 30), F.lit("")), F.substring(finding["evidence"], 1, 30), F.lit(""))
    page = F.when(finding["paragraph_index"] >= 0, finding["paragraph_index"] + 1)
    return F.struct(dimension.alias("dimension"), finding["severity"].alias("severity"), page.alias("page_number"), shown.alias("highlight"))


def with_locations(results: DataFrame) -> DataFrame:
    """Results with the locations of their findings."""
    return results.withColumn("locations", F.transform("findings", lambda f: location(f, F.col("dimension"))))


def evidence(finding: Column) -> Column:
    """The part of a finding that proves it."""
    return F.struct(finding["evidence"].alias("text"), finding["chunk_id"].alias("chunk_id"), finding["section_path"].alias("section_path"))


def by_section(findings: DataFrame, path: str = "section_path") -> list[Column]:
    """The order of findings in reports: by section, those without one last."""
    return [(F.coalesce(path, F.lit("")) == "").asc(), F.col(path).asc()]


def findings_section(findings: DataFrame) -> DataFrame:
    """(doc_id, text): the findings of a document in the order of their sections, a line for each."""
    line = F.concat(F.lit("- ["), F.coalesce("severity", F.lit("medium")), F.lit("] "), F.when(F.coalesce("section_path", F.lit("")) != "", F.concat("section_path", F.lit(": "))).otherwise(""), "description")
    key = F.struct((F.coalesce("section_path", F.lit("")) == "").alias("last"), F.coalesce("section_path", F.lit("")).alias("path"), F.col("pos"), line.alias("line"))
    return findings.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["line"]), "\n").alias("text"))


def opinions_section(rows: DataFrame) -> DataFrame:
    """(doc_id, text): the opinions of a document by dimension, a line for each."""
    line = F.concat(F.lit("- "), "dimension", F.lit(" ("), "verdict", F.lit("): "), "opinion")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dimension", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def dimension_summaries(results: DataFrame) -> DataFrame:
    """(doc_id, overall_verdict, total_score, need_review, elapsed, dimensions): what a task shows of its result."""
    part = F.struct("dimension", "verdict", "score", "confidence", F.size("findings").alias("n_findings"))
    return results.groupBy("doc_id").agg(
        *folds.overall(), F.coalesce(F.bool_or("need_human_review"), F.lit(False)).alias("need_review"), F.bround(F.max("elapsed_seconds"), 2).alias("elapsed"), F.array_sort(F.collect_list(part)).alias("dimensions"))


def by_module(results: DataFrame, module: Column) -> DataFrame:
    """(module, n, score, n_problem) of a document's results grouped into modules."""
    return results.groupBy(module.alias("module")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("score", F.lit(0))).cast("long").alias("score"), F.count_if(F.col("verdict") != "pass").alias("n_problem"))


def located_findings(findings: DataFrame, dimension: str | None = None, severity: str | None = None) -> DataFrame:
    """The findings that a viewer asks for: any of both predicates may be left out."""
    wanted = [F.col(c) == v for c, v in (("dimension", dimension), ("severity", severity)) if v]
    return findings.where(reduce(lambda a, b: a & b, wanted, F.lit(True)))
