"""Rules over facts of plans and images, and the arbitration of raters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import folds


def coverage(docs: DataFrame, key: str, text: Column, groups: dict[str, list[str]]) -> DataFrame:
    """(key, covered, ratio, missing): the word groups that a text covers."""
    missing = F.array_compact(F.array(*[F.when(~tx.any_of(text, ws), F.lit(name)) for name, ws in groups.items()]))
    rows = docs.select(key, missing.alias("missing"))
    covered = F.lit(len(groups)) - F.size("missing")
    return rows.select(key, covered.cast("long").alias("covered"), (covered / len(groups)).alias("ratio"), "missing")


def share_ladder(ratio: Column, steps: list[tuple[float, str, int]], rest: tuple[str, int]) -> list[Column]:
    """verdict and score by the first share that the ratio reaches."""
    verdict = tx.first_match(ratio, [(ratio >= share, F.lit(v)) for share, v, _ in steps], F.lit(rest[0]))
    score = tx.first_match(ratio, [(ratio >= share, F.lit(n)) for share, _, n in steps], F.lit(rest[1]))
    return [verdict.alias("verdict"), score.cast("long").alias("score")]


def date_near(text: Column, keyword: str, reach: int = 50) -> Column:
    """The first date within `reach` characters after a keyword, in any of three notations; null without one."""
    after = F.substring(text, F.instr(text, keyword), F.lit(len(keyword) + reach))
    pattern = r"((?:19|20)[0-9]{2})\s*[-年./]\s*([0-9]{1,2})\s*[-月./]\s*([0-9]{1,2})"
    part = lambda i: F.nullif(F.regexp_extract(after, pattern, i), F.lit(""))
    return F.when(F.instr(text, keyword) > 0, F.try_to_date(F.concat_ws("-", F.when(part(3).isNotNull(), part(1)), part(2), part(3)), "y-M-d"))


def time_order(dates: DataFrame, key: str, steps: list[str]) -> DataFrame:
    """(key, n_dates, inverted, many_years, verdict): later steps must not come before earlier ones."""
    known = F.array_compact(F.array(*steps))
    inverted = reduce(lambda a, b: a | b, [F.coalesce(F.col(a) > F.col(b), F.lit(False)) for i, a in enumerate(steps) for b in steps[i + 1 :]])
    years = F.size(F.array_distinct(F.transform(known, F.year))) > 1
    rows = dates.select(key, F.size(known).alias("n_dates"), inverted.alias("inverted"), years.alias("many_years"))
    verdict = F.when(F.col("n_dates") < 2, "uncertain").when(F.col("inverted"), "fail").when(F.col("many_years"), "partial").otherwise("pass")
    return rows.select("*", verdict.alias("verdict"))


def potentials(text: Column) -> Column:
    """Protection potentials in a text, in volts."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)([-−－]\s*[0-9](?:\.[0-9]+)?)\s*V"), F.lit(1))
    return F.transform(found, lambda x: F.translate(F.regexp_replace(x, r"(?U)\s", ""), "−－", "--").cast("double"))


def outside_range(values: Column, low: float, high: float) -> Column:
    """The values that lie outside."""
    return F.filter(values, lambda v: ~v.between(low, high))


def missing_kinds(present: DataFrame, required: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, n_required, missing, verdict): required kinds of each key minus the present ones."""
    marked = required.join(present.select(key, kind, F.lit(True).alias("_here")).distinct(), [key, kind], "left")
    rows = marked.groupBy(key).agg(F.count(F.lit(1)).alias("n_required"), F.array_sort(F.collect_list(F.when(F.col("_here").isNull(), F.col(kind)))).alias("missing"))
    n = F.size("missing")
    return rows.select("*", F.when(n == 0, "pass").when(n <= F.floor(F.col("n_required") / 2), "partial").otherwise("fail").alias("verdict"))


def checklist_issues(answers: DataFrame, key: list[str], answer: str, bad_words: list[str], severe_words: list[str]) -> DataFrame:
    """(key, item, severity): items of a map of answers that are no, unsure or missing.

    An item is severe by words in its name.
    """
    rows = answers.select(*key, F.explode(answer).alias("item", "value"))
    bad = F.lower("value").isin("false", "uncertain", "") | tx.any_of(F.col("value"), bad_words)
    return rows.where(bad).select(*key, "item", F.when(tx.any_of(F.col("item"), severe_words), "high").otherwise("medium").alias("severity"))


def checklist_verdict(rows: DataFrame, n: str = "n_issues", confidence: str = "confidence") -> DataFrame:
    """Fold of checklist raters: no issue passes, a sure rater is partial, an unsure one fails."""
    k, sure = F.col(n), F.col(confidence) >= 70
    verdict = F.when(k == 0, "pass").when(sure, "partial").otherwise("fail")
    score = F.when(k == 0, 12).when(sure, F.greatest(F.lit(4), 12 - 2 * k)).otherwise(F.greatest(F.lit(0), 12 - 3 * k))
    return rows.select("*", verdict.alias("verdict"), score.cast("long").alias("score"))


def evidence_vote(claims: DataFrame, texts: DataFrame, key: list[str], doc: str, evidence: str, text: str) -> DataFrame:
    """(key, n_claims, n_found, verified): the first three longer pieces of evidence, found word for word.

    Half of them, and at least one, must be found; a rater without evidence counts as verified.
    """
    named = claims.select(*key, doc, evidence, "pos")
    first = Window.partitionBy(*key).orderBy(F.when(F.length(evidence) > 10, 0).otherwise(1), "pos")
    picked = named.withColumn("_rn", F.row_number().over(first)).where((F.col("_rn") <= 3) & (F.length(evidence) > 10))
    checked = picked.join(texts.select(doc, text), doc, "left").withColumn("_hit", F.coalesce(F.col(text).contains(F.substring(evidence, 1, 200)), F.lit(False)))
    votes = checked.groupBy(*key).agg(F.count(F.lit(1)).alias("n_claims"), F.count_if("_hit").alias("n_found"))
    every = claims.select(*key).distinct().join(votes, key, "left").na.fill(0, ["n_claims", "n_found"])
    return every.withColumn("verified", (F.col("n_claims") == 0) | (F.col("n_found") >= F.greatest(F.lit(1), F.floor(F.col("n_claims") / 2))))


def audit_report(results: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, overall_verdict, total_score, normalised, report): results and findings as Markdown."""
    lines = findings.groupBy("doc_id", "dimension").agg(F.array_sort(F.collect_list(F.struct("severity", "description"))).alias("fs"))
    joined = results.join(lines, ["doc_id", "dimension"], "left")
    bullet = F.array_join(F.transform(F.coalesce("fs", F.array().cast("array<struct<severity:string,description:string>>")), lambda f: F.concat(F.lit("\n- ["), f["severity"], F.lit("] "), f["description"])), "")
    section = F.concat(F.lit("## "), "dimension", F.lit(": "), "verdict", F.lit(" ("), F.coalesce(F.col("score"), F.lit(0)).cast("string"), F.lit(")"), bullet)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("dimension", section.alias("s")))), lambda x: x["s"])
    rolled = joined.groupBy("doc_id").agg(*folds.overall(), F.array_join(parts, "\n\n").alias("body"))
    head = F.concat(F.lit("# "), "doc_id", F.lit("\n\nverdict: "), "overall_verdict", F.lit("\n\n"))
    # the greatest score is fixed at 132 points
    return rolled.select("doc_id", "overall_verdict", "total_score", F.bround(F.col("total_score") / 132 * 100, 0).cast("long").alias("normalised"), F.concat(head, "body").alias("report"))
