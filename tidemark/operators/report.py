"""The report of a review: what is critical, what to do, and all dimensions in their parts, as rows and as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import folds

RECOMMENDATIONS = 10
#: The parts of a report: dimensions by the first letter of their name.
PARTS = {"Content": ("C",), "Depth and consistency": ("E", "I", "L"), "Template": ("G",), "Metrics": ("T",)}
_SEVERITIES = ("high", "medium", "low")
_OPINION = "struct<pos:long,severity:string,verdict:string,opinion:string>"


def report_summary(opinions: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, critical_issues, recommendations, n_high, n_medium, n_low, need_review, overall_verdict, total_score).

    opinions: doc_id, dimension, pos, severity, verdict, opinion, suggestions. Critical are those of high severity
    that do not pass; recommendations are the different suggestions in their order, ten at most. Counts are those of
    the opinions, or of the findings where a document has no opinion. results: doc_id, dimension, verdict, score,
    need_review, findings.
    """
    critical = (F.col("severity") == "high") & (F.col("verdict") != "pass")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["o"])
    place = F.struct("dimension", "pos", F.col("opinion").alias("o"))
    told = opinions.groupBy("doc_id").agg(listed(F.when(critical, place)).alias("critical_issues"), F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("severity") == s).alias(f"_o_{s}") for s in _SEVERITIES])
    said = opinions.select("doc_id", "dimension", "pos", F.posexplode("suggestions").alias("i", "s")).where(F.coalesce("s", F.lit("")) != "")
    first = said.groupBy("doc_id", "s").agg(F.min(F.struct("dimension", "pos", "i")).alias("at"))
    advice = first.groupBy("doc_id").agg(F.slice(listed(F.struct("at", F.col("s").alias("o"))), 1, RECOMMENDATIONS).alias("recommendations"))
    count = lambda s: F.sum(F.size(F.filter(F.coalesce("findings", F.array().cast(results.schema["findings"].dataType)), lambda f: f["severity"] == s))).alias(f"_f_{s}")
    every = results.groupBy("doc_id").agg(*folds.overall(), F.coalesce(F.bool_or("need_review"), F.lit(False)).alias("need_review"), *[count(s) for s in _SEVERITIES])
    none = F.array().cast("array<string>")
    rows = every.join(told, "doc_id", "left").join(advice, "doc_id", "left")
    own = F.coalesce("_n", F.lit(0)) > 0
    return rows.select(
        "doc_id", F.coalesce("critical_issues", none).alias("critical_issues"), F.coalesce("recommendations", none).alias("recommendations"),
        *[F.when(own, F.col(f"_o_{s}")).otherwise(F.col(f"_f_{s}")).cast("long").alias(f"n_{s}") for s in _SEVERITIES], "need_review", "overall_verdict", "total_score")


def part_of(dimension: Column, parts: dict[str, tuple[str, ...]] = PARTS) -> Column:
    """The part that a dimension stands in, numbered; those of no part come last."""
    out = F.lit(None).cast("struct<n:int,title:string>")
    for n, (title, letters) in reversed(list(enumerate(parts.items(), 1))):
        out = F.when(F.substring(dimension, 1, 1).isin(*letters), F.struct(F.lit(n).alias("n"), F.lit(title).alias("title"))).otherwise(out)
    return F.coalesce(out, F.struct(F.lit(len(parts) + 1).alias("n"), F.lit("Other").alias("title")))


def _cell(value: Column) -> Column:
    """A value that stays within its cell of a Markdown table."""
    return F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


def dimension_sections(results: DataFrame, opinions: DataFrame) -> DataFrame:
    """(doc_id, dimension, part, text): a section for each dimension: its opinions in order, or else its findings by severity."""
    rank = lambda s: F.when(s == "high", 0).when(s == "medium", 1).otherwise(2)
    told = opinions.groupBy("doc_id", "dimension").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long"), "severity", "verdict", "opinion"))).cast(f"array<{_OPINION}>").alias("os"))
    rows = results.join(told, ["doc_id", "dimension"], "left")
    bullets = lambda xs, text: F.array_join(F.transform(xs, lambda x: F.concat(F.lit("\n- ["), F.coalesce(x["severity"], F.lit("medium")), F.lit("] "), F.coalesce(x[text], F.lit("")))), "")
    ordered = F.transform(F.array_sort(F.transform("findings", lambda f, i: F.struct(rank(f["severity"]).alias("r"), i.alias("i"), f["severity"].alias("severity"), f["description"].alias("description")))), lambda x: x)
    body = F.when(F.size("os") > 0, bullets(F.col("os"), "opinion")).when(F.size("findings") > 0, bullets(ordered, "description")).otherwise("\n- nothing found")
    head = F.concat(F.lit("### "), "dimension", F.lit(": "), F.coalesce("verdict", F.lit("uncertain")), F.lit(" ("), F.coalesce(F.col("score").cast("string"), F.lit("-")), F.lit(")\n"))
    return rows.select("doc_id", "dimension", part_of(F.col("dimension")).alias("part"), F.concat(head, body).alias("text"))


def full_report(docs: DataFrame, results: DataFrame, opinions: DataFrame) -> DataFrame:
    """(doc_id, report): an overview, the parts with their dimensions, and what to do, as Markdown.

    docs: doc_id, name, summary, elapsed. A document without results has its overview alone, as uncertain.
    """
    sections = dimension_sections(results, opinions).groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("dimension", "text"))).alias("ds"))
    lines = F.array_join(F.transform("ds", lambda d: d["text"]), "\n\n")
    titled = sections.select("doc_id", "part.n", F.concat(F.lit("## Part "), F.col("part.n").cast("string"), F.lit(": "), "part.title", F.lit("\n\n"), lines).alias("text"))
    parts = titled.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda p: p["text"]), "\n\n").alias("_parts"))
    rows = docs.join(report_summary(opinions, results), "doc_id", "left").join(parts, "doc_id", "left")
    line = lambda name, value: F.concat(F.lit(f"| {name} | "), _cell(value), F.lit(" |"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    table = F.concat_ws(
        "\n", F.concat(F.lit("# "), _cell(F.coalesce("name", F.col("doc_id").cast("string")))), F.lit(""), F.lit("| | |\n|-|-|"), line("document", F.col("doc_id").cast("string")), line("about", F.col("summary")),
        line("seconds", F.format_string("%.1f", F.coalesce("elapsed", F.lit(0.0)))), line("high, medium, low", F.concat_ws(", ", number("n_high"), number("n_medium"), number("n_low"))),
        line("verdict", F.coalesce("overall_verdict", F.lit("uncertain"))), line("score", number("total_score")), line("review", F.when(F.coalesce("need_review", F.lit(True)), "yes").otherwise("no")))
    numbered = lambda c: F.array_join(F.transform(c, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    block = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {title}\n\n"), numbered(F.col(c))))
    return rows.select("doc_id", F.concat_ws("\n\n", table, block("Critical", "critical_issues"), "_parts", block("What to do", "recommendations")).alias("report"))
