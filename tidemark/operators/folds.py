"""Folds of findings into verdicts, scores and confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def severity_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    """n_high, n_medium and n_low findings of each key; the key's rows may carry a null severity."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    return findings.groupBy(*by).agg(count("high"), count("medium"), count("low"))


def ladder(cases: list[tuple[Column, tuple[str, Column | int, Column | int]]]) -> list[Column]:
    """verdict, score and confidence of the first case that holds; the last case is the rest."""
    columns = []
    for i, (name, kind) in enumerate((("verdict", "string"), ("score", "long"), ("confidence", "long"))):
        out = None
        for test, values in cases[:-1]:
            value = values[i] if isinstance(values[i], Column) else F.lit(values[i])
            out = F.when(test, value) if out is None else out.when(test, value)
        rest = cases[-1][1][i]
        columns.append(out.otherwise(rest if isinstance(rest, Column) else F.lit(rest)).cast(kind).alias(name))
    return columns


def structure_verdict(high: str = "n_high", medium: str = "n_medium", low: str = "n_low") -> list[Column]:
    """Fold of the structure rules."""
    h, m, s = F.col(high), F.col(medium), F.col(low)
    return ladder([(h + m + s == 0, ("pass", 15, 95)), ((h > 0) | (m >= 3), ("fail", 5, 90)), (m >= 1, ("partial", 10, 88)), (F.lit(True), ("partial", 13, 85))])


def language_verdict(high: str = "n_high", medium: str = "n_medium", low: str = "n_low") -> list[Column]:
    """Fold of the language and reference rules."""
    h, m, s = F.col(high), F.col(medium), F.col(low)
    return ladder([
        (h + m + s == 0, ("pass", 12, 95)), (h > 0, ("fail", 4, 90)),
        (m > 0, ("partial", 8, F.least(F.lit(90), 75 + 2 * m))), (F.lit(True), ("partial", 10, F.least(F.lit(85), 80 - s))),
    ])


def overall(verdict: str = "verdict", score: str = "score") -> list[Column]:
    """Roll-up of dimension verdicts: any fail, all pass, any uncertain, else partial; scores add up."""
    v = F.col(verdict)
    folded = (
        F.when(F.count(v) == 0, "uncertain").when(F.bool_or(v == "fail"), "fail").when(F.bool_and(v == "pass"), "pass")
        .when(F.bool_or(v == "uncertain"), "uncertain").otherwise("partial")
    )
    return [folded.alias("overall_verdict"), F.sum(F.coalesce(F.col(score), F.lit(0))).cast("long").alias("total_score")]


def strictness(verdict: Column) -> Column:
    """Order of verdicts by strictness: fail, partial, uncertain, pass."""
    return F.when(verdict == "fail", 3).when(verdict == "partial", 2).when(verdict == "uncertain", 1).otherwise(0)


def merge_raters(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Two raters' (key, verdict, score, confidence) merged.

    Equal verdicts average (rounded down); different ones take the stricter, the first on a tie, with the
    confidence cut to 70 and a review; a key of one rater only is taken as it is, with a review.
    """
    left = a.select(*key, F.struct("verdict", "score", "confidence").alias("a"))
    right = b.select(*key, F.struct("verdict", "score", "confidence").alias("b"))
    both = left.join(right, key, "full")
    agree = F.col("a.verdict") == F.col("b.verdict")
    a_stricter = strictness(F.col("a.verdict")) >= strictness(F.col("b.verdict"))
    stricter = F.when(a_stricter, F.col("a")).otherwise(F.col("b"))
    mean = lambda f: F.floor((F.col(f"a.{f}") + F.col(f"b.{f}")) / 2)
    one = F.coalesce("a", "b")
    single = F.col("a").isNull() | F.col("b").isNull()
    pick = lambda f, merged: F.when(single, one[f]).when(agree, merged).otherwise(stricter[f])
    confidence = F.when(single, one["confidence"]).when(agree, mean("confidence")).otherwise(F.least(stricter["confidence"], F.lit(70)))
    return both.select(
        *key,
        pick("verdict", F.col("a.verdict")).alias("verdict"),
        pick("score", mean("score")).cast("long").alias("score"),
        confidence.cast("long").alias("confidence"),
        F.when(F.col("b").isNull(), "a_only").when(F.col("a").isNull(), "b_only").when(agree, "agree").otherwise("diverge").alias("source_tag"),
        (single | F.coalesce(~agree, F.lit(True)) | (confidence < 50)).alias("need_review"),
    )
