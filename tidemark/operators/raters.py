"""Two raters and a critic: merges with findings, agreement, review, arbitration, skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import model
from tidemark.operators import folds
from tidemark.session import small

FINDING = "struct<severity:string,description:string,evidence:string,rule_id:string>"
RESULT = ["verdict", "score", "confidence", "findings", "need_review"]
_NONE = f"array<{FINDING}>"


def findings_union(a: Column, b: Column) -> Column:
    """The findings of a, then those of b whose description a lacks; b's own repeats are left out."""
    seen = lambda all_, f: F.exists(all_, lambda x: x["description"].eqNullSafe(f["description"]))
    return F.aggregate(b, a, lambda out, f: F.when(seen(out, f), out).otherwise(F.concat(out, F.array(f))))


def merge_results(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Two raters' results (key, verdict, score, confidence, findings, need_review) merged.

    Equal verdicts: means rounded down, findings united, a review where either asks for it or the mean
    confidence is under 50. Different ones: the stricter result, the first on a tie, with a confidence of 70
    at most and a review. A key of one rater only: its result, with a review.
    """
    left, right = a.select(*key, F.struct(*RESULT).alias("a")), b.select(*key, F.struct(*RESULT).alias("b"))
    rows = left.join(right, key, "full")
    none = F.array().cast(_NONE)
    agree = F.col("a.verdict") == F.col("b.verdict")
    chosen = F.when(folds.strictness(F.col("a.verdict")) >= folds.strictness(F.col("b.verdict")), F.col("a")).otherwise(F.col("b"))
    one = F.coalesce("a", "b")
    single = F.col("a").isNull() | F.col("b").isNull()
    mean = lambda f: F.floor((F.coalesce(F.col(f"a.{f}"), F.lit(0)) + F.coalesce(F.col(f"b.{f}"), F.lit(0))) / 2).cast("long")
    pick = lambda alone, same, other: F.when(single, alone).when(agree, same).otherwise(other)
    sure = mean("confidence")
    return rows.select(
        *key,
        pick(one["verdict"], F.col("a.verdict"), chosen["verdict"]).alias("verdict"),
        pick(one["score"].cast("long"), mean("score"), chosen["score"].cast("long")).alias("score"),
        pick(one["confidence"].cast("long"), sure, F.least(chosen["confidence"], F.lit(70)).cast("long")).alias("confidence"),
        pick(one["findings"], findings_union(F.coalesce("a.findings", none), F.coalesce("b.findings", none)), chosen["findings"]).alias("findings"),
        pick(F.lit(True), F.coalesce("a.need_review", F.lit(False)) | F.coalesce("b.need_review", F.lit(False)) | (sure < 50), F.lit(True)).alias("need_review"),
        F.when(F.col("b").isNull(), "a_only").when(F.col("a").isNull(), "b_only").when(agree, "merged")
        .when(folds.strictness(F.col("a.verdict")) >= folds.strictness(F.col("b.verdict")), "A").otherwise("B").alias("selected_from"),
    )


def fallback_merge(rows: DataFrame, a: str = "a", b: str = "b", a_verified: str = "a_verified", b_verified: str = "b_verified") -> DataFrame:
    """rows with the merge that stands in for a critic that failed.

    a and b are explorer answers (verdict_hint, score_hint, confidence, findings). The base is b if its
    evidence was verified, else a; a's high findings that the base lacks are added if a was verified.
    """
    none = F.array().cast(_NONE)
    base = F.when(F.col(b_verified), F.col(b)).otherwise(F.col(a))
    own = F.coalesce(base["findings"], none)
    lacking = F.filter(F.coalesce(F.col(f"{a}.findings"), none), lambda f: (f["severity"] == "high") & ~F.exists(own, lambda g: g["description"].eqNullSafe(f["description"])))
    verdict = F.lower(F.coalesce(base["verdict_hint"], F.lit("uncertain")))
    return rows.withColumns({
        "verdict": F.when(verdict.isin(*model.VERDICTS), verdict).otherwise("uncertain"),
        "score": F.coalesce(base["score_hint"], F.lit(0)).cast("long"),
        "confidence": F.least(F.coalesce(base["confidence"], F.lit(40)), F.lit(70)).cast("long"),
        "findings": F.when(F.col(a_verified), F.concat(own, lacking)).otherwise(own),
        "selected_from": F.when(F.col(b_verified), "B").otherwise("merged"),
        "evidence_verified": F.col(a_verified) & F.col(b_verified),
        "need_review": F.lit(True),
    })


def needs_review(dimension: Column, verdict: Column, confidence: Column, n_high: Column, evidence_verified: Column, selected_from: Column, rules_passed: Column, coverage_rate: Column, asked: Column) -> Column:
    """Whether a person must look: each clause by itself suffices. Null stands for what is not known."""
    clauses = [
        verdict == "uncertain", ~evidence_verified, confidence < 50, selected_from == "critic_only",
        (dimension == "E1_staffing") & (rules_passed <= 2), (dimension == "E2_emergency") & (F.coalesce(F.nullif(coverage_rate, F.lit(0.0)), F.lit(1.0)) < 0.4),
        n_high >= 3, asked,
    ]
    out = F.lit(False)
    for clause in clauses:
        out = out | F.coalesce(clause, F.lit(False))
    return out


def critic_results(df: DataFrame, answer: str) -> DataFrame:
    """df with the critic's typed answer and whether a person must look at it."""
    rows = model.critic_answers(df, answer)
    high = F.size(F.filter("findings", lambda f: f["severity"] == "high"))
    unknown = F.lit(None)
    review = F.col("human_review_required") | needs_review(
        F.col("dimension"), F.col("verdict"), F.col("confidence"), high, F.col("evidence_verified"), F.col("selected_from"), unknown.cast("int"), unknown.cast("double"), F.lit(False))
    return rows.withColumns({"need_review": review, "details": F.substring("reasoning", 1, 500)})


def arbitrated(merged: DataFrame, answers: DataFrame, key: list[str], low: int = 1, high: int = 6) -> DataFrame:
    """Merged results in which the model's answers replace what diverges.

    `answers` has (key, dimension, verdict, score, confidence). They count only for dimensions that
    diverge, and only where a document has between `low` and `high` of these.
    """
    diverging = merged.where(F.col("selected_from").isin("A", "B"))
    open_ = diverging.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(low, high))
    clamp = lambda c, top: F.greatest(F.lit(0), F.least(F.lit(top), c)).cast("long")
    asked = diverging.select(*key, "dimension").join(open_, key, "left_semi")
    ruled = answers.where(F.col("verdict").isin(*model.VERDICTS)).join(asked, [*key, "dimension"], "left_semi").select(
        *key, "dimension", F.struct("verdict", clamp(F.col("score"), 12).alias("score"), clamp(F.col("confidence"), 100).alias("confidence")).alias("_r"))
    rows = merged.join(ruled, [*key, "dimension"], "left")
    out = {c: F.coalesce(F.col(f"_r.{c}"), F.col(c)) for c in ("verdict", "score", "confidence")}
    out["selected_from"] = F.when(F.col("_r").isNotNull(), "arbitrated").otherwise(F.col("selected_from"))
    return rows.withColumns(out).drop("_r")


def downgraded(results: DataFrame, key: list[str], pairs: list[tuple[str, str]], by: int = 15) -> DataFrame:
    """Results in which a passed dimension loses confidence where the dimension that contradicts it failed."""
    verdicts = results.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("dimension", "verdict"))).alias("_v"))
    rows = results.join(verdicts, key)
    hit = F.lit(False)
    for passed, failed in pairs:
        hit = hit | ((F.col("dimension") == passed) & (F.try_element_at("_v", F.lit(passed)) == "pass") & (F.try_element_at("_v", F.lit(failed)) == "fail"))
    lowered = F.greatest(F.lit(0), F.col("confidence") - F.when(F.coalesce(hit, F.lit(False)), by).otherwise(0)).cast("long")
    return rows.withColumn("confidence", lowered).drop("_v")


def canonical(contradictions: Column) -> Column:
    """A list of structs as sorted JSON, so that two lists of the same members are equal; null is empty."""
    return F.array_sort(F.transform(F.coalesce(contradictions, F.array()), lambda c: F.to_json(c)))


def explorers_agree(a: Column, b: Column) -> Column:
    """Whether two explorers found the same contradictions and hint at the same known verdict."""
    ha, hb = F.lower(a["verdict_hint"]), F.lower(b["verdict_hint"])
    return F.coalesce((canonical(a["contradictions"]) == canonical(b["contradictions"])) & (ha == hb) & ha.isin(*model.VERDICTS), F.lit(False))


def agreed_result(b: Column) -> Column:
    """The result of explorers that agree, from the second one's answer."""
    hint = F.lower(F.coalesce(b["verdict_hint"], F.lit("uncertain")))
    clamp = lambda c, top, default: F.greatest(F.lit(0), F.least(F.lit(top), F.coalesce(c, F.lit(default)))).cast("long")
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    findings = F.transform(b["contradictions"], lambda c, i: F.struct(
        F.coalesce(c["severity"], F.lit("medium")).alias("severity"), cut(c["description"], 800).alias("description"),
        F.substring(F.concat(F.coalesce(c["quote_a"], F.lit("")), F.lit(" | "), F.coalesce(c["quote_b"], F.lit(""))), 1, 600).alias("evidence"),
        F.coalesce(F.nullif(c["id"], F.lit("")), F.concat(F.lit("C5.c"), i.cast("string"))).alias("rule_id")))
    return F.struct(
        F.when(hint.isin(*model.VERDICTS), hint).otherwise("partial").alias("verdict"), clamp(b["score_hint"], 12, 8).alias("score"), clamp(b["confidence_hint"], 100, 85).alias("confidence"),
        F.coalesce(findings, F.array().cast(_NONE)).alias("findings"), F.coalesce(b["summary"], F.lit("")).alias("details"))


def logic_results(rows: DataFrame, a: str = "a", b: str = "b", critic: str = "critic") -> DataFrame:
    """rows with `agree` and the result: the second explorer's where they agree, else the critic's."""
    agree = explorers_agree(F.col(a), F.col(b))
    return rows.withColumn("agree", agree).withColumn("result", F.when(F.col("agree"), agreed_result(F.col(b))).otherwise(F.col(critic)))


def skills_of(critic: DataFrame, least: int = 80) -> DataFrame:
    """(skill_id, name, dimension, pattern, solution): what sure results teach; the id is a hash of its content."""
    kept = critic.where((F.col("confidence") >= least) & (F.coalesce("skill_name", F.lit("")) != "") & (F.coalesce("skill_solution", F.lit("")) != ""))
    ident = F.concat_ws("_", "dimension", "skill_name", F.substring(F.md5(F.concat_ws("\x1f", "dimension", "skill_name", "skill_solution")), 1, 6))
    pattern = F.coalesce(F.nullif("skill_pattern", F.lit("")), F.concat("dimension", F.lit(" 审核技能")))
    return kept.select(ident.alias("skill_id"), F.col("skill_name").alias("name"), "dimension", pattern.alias("pattern"), F.col("skill_solution").alias("solution"))


def remaining(docs: DataFrame, dims: DataFrame, done: DataFrame) -> DataFrame:
    """(doc_id, dimension, group): what a resumed run still has to do.

    `dims` (dimension, group, needs_images) is the catalogue; dimensions on images are left out for
    documents without any (docs: doc_id, has_images); done (doc_id, dimension) is not done again.
    """
    wanted = docs.join(small(dims), F.col("has_images") | ~F.col("needs_images"))
    return wanted.select("doc_id", "dimension", "group").join(done.select("doc_id", "dimension"), ["doc_id", "dimension"], "left_anti")


def fan_out(work: DataFrame, answer: Column) -> DataFrame:
    """Work rows with their typed answers; an empty answer (a failure or time-out) is uncertain, with a review."""
    rows = model.typed_results(work.withColumn("_answer", answer), "_answer")
    failed = F.coalesce(F.col("_answer"), F.lit("")) == ""
    return rows.withColumns({"need_review": failed | (F.col("confidence") < 50), "confidence": F.when(failed, 10).otherwise(F.col("confidence")), "_error": failed}).drop("_answer")


def marked_done(state: DataFrame, finished: DataFrame) -> DataFrame:
    """Session rows (doc_id, completed array, failed array) with finished (doc_id, dimension, ok) added, each name once."""
    pick = lambda ok: F.array_sort(F.collect_set(F.when(F.col("ok") == ok, F.col("dimension"))))
    fresh = finished.groupBy("doc_id").agg(pick(True).alias("_done"), pick(False).alias("_failed"))
    none = F.array().cast("array<string>")
    rows = state.join(fresh, "doc_id", "left")
    add = lambda old, new: F.array_union(F.coalesce(old, none), F.coalesce(new, none))
    return rows.withColumns({"completed": add("completed", "_done"), "failed": add("failed", "_failed")}).drop("_done", "_failed")


def restored(labels: DataFrame, state: DataFrame) -> DataFrame:
    """The stored results of the dimensions that a session has completed."""
    done = state.select("doc_id", F.explode("completed").alias("dimension")).distinct()
    return labels.join(done, ["doc_id", "dimension"], "left_semi")


def batch_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, human_review, failed) of whole batches."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("need_review").alias("human_review"), F.count_if(F.col("overall_verdict") == "fail").alias("failed"))
