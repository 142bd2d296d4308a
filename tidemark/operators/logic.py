"""The logic dimension from rows to verdicts: two explorers of contradictions, and a critic only where they differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import model
from tidemark.functions.text import any_of
from tidemark.operators.raters import agreed_result, explorers_agree
from tidemark.operators.retrieval import excerpt_text
from tidemark.operators.sequence import priority_budget
from tidemark.session import written

EXPLORER = (
    "verdict_hint string, score_hint int, confidence_hint int, summary string, "
    "contradictions array<struct<id:string,severity:string,description:string,quote_a:string,quote_b:string>>"
)
MAX_ROWS, MAX_CHARS = 40, 6500


def explored(answer: Column) -> Column:
    """An explorer's answer as a struct of EXPLORER; null where it gave no object."""
    return F.from_json(model.json_object(answer), EXPLORER)


def logic_review(chunks: DataFrame, words: list[str], explorer_a: Callable, explorer_b: Callable, critic: Callable, snippets: DataFrame | None = None) -> DataFrame:
    """(doc_id, verdict, score, confidence, findings, need_review, details, path): contradictions within each document.

    The explorers get an excerpt of text and headings, rows with `words` first, and the clauses of snippets (doc_id,
    text). Where they name the same contradictions and hint at the same verdict, the second one's answer stands
    (`ab_merge`); else the critic, who alone is asked for these, decides (`critic`). A document without text, and one
    whose explorers or critic gave no object, is uncertain (15; path `none`). Every call is made once.
    """
    spark = chunks.sparkSession
    rows = chunks.where(F.lower("chunk_type").isin("text", "heading") & (F.trim("content") != ""))
    kept = priority_budget(rows, ["doc_id"], any_of(F.col("content"), words), ["pos"], MAX_ROWS, MAX_CHARS, "content")
    docs = chunks.select("doc_id").distinct()
    asked = excerpt_text(kept, ["doc_id"], "rn", "excerpt")
    asked = asked.withColumn("_clauses", F.lit("")) if snippets is None else asked.join(snippets.select("doc_id", F.col("text").alias("_clauses")), "doc_id", "left")
    prompt = F.concat_ws("\n", F.lit("contradictions as JSON: verdict_hint, score_hint, confidence_hint, summary, contradictions"), "_clauses", "excerpt")
    told = asked.withColumns({"_a": model.model_column(explorer_a, prompt), "_b": model.model_column(explorer_b, prompt)})
    told = written(spark, told.withColumns({"a": explored(F.col("_a")), "b": explored(F.col("_b"))}).drop("_a", "_b"), "logic-explorers")
    told = told.withColumn("agree", F.coalesce(explorers_agree(F.col("a"), F.col("b")), F.lit(False)) & F.col("a").isNotNull() & F.col("b").isNotNull())
    kind = "array<struct<severity:string,description:string,evidence:string,rule_id:string>>"
    names = ["doc_id", "verdict", "score", "confidence", "findings", "details", "path"]
    shape = lambda df: df.select("doc_id", "verdict", F.col("score").cast("long"), F.col("confidence").cast("long"), F.col("findings").cast(kind), "details", "path")
    merged = shape(told.where("agree").select("doc_id", agreed_result(F.col("b")).alias("r")).select("doc_id", "r.*").withColumn("path", F.lit("ab_merge")))
    sides = [F.concat(F.lit(f"{s}: "), F.substring(F.to_json(s), 1, 3000)) for s in ("a", "b")]
    open_ = told.where("not agree and a is not null and b is not null")
    ruled = written(spark, open_.select("doc_id", model.json_object(model.model_column(critic, F.concat_ws("\n", F.lit("critic: verdict, score, confidence, findings as JSON"), "excerpt", *sides))).alias("_j")), "logic-critic")
    details = F.coalesce(F.try_variant_get(F.try_parse_json("_j"), "$.details", "string"), F.lit(""))
    decided = shape(model.typed_results(ruled.where("_j is not null"), "_j").withColumns({"details": details, "path": F.lit("critic")}))
    some = merged.unionByName(decided)
    out = docs.join(some, "doc_id", "left")
    lost = F.col("path").isNull()
    verdict, confidence = F.coalesce("verdict", F.lit("uncertain")), F.coalesce("confidence", F.lit(15).cast("long"))
    return out.withColumns({"need_review": lost | (verdict == "uncertain") | (confidence < 50)}).select(
        "doc_id", verdict.alias("verdict"), F.coalesce("score", F.lit(0).cast("long")).alias("score"), confidence.alias("confidence"), F.coalesce("findings", F.array().cast(kind)).alias("findings"),
        "need_review", F.coalesce("details", F.lit("")).alias("details"), F.coalesce("path", F.lit("none")).alias("path")).select(*names, "need_review")
