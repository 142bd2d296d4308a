"""The emergency dimension from rows to verdicts: sides, steps, their alignment, and a model's review of all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import model
from tidemark.operators.consistency import clean_steps, compared_steps, emergency_sides
from tidemark.session import written

SIDES = ("main", "appendix", "both", "none")
_STEPS = "steps of the main text and of the appendix as JSON: main_steps, appendix_steps, missing_side, summary"
_REVIEW = "review of the emergency measures against the clauses as JSON: verdict, score, confidence, findings"
_NONE = "array<string>"


def _listed(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t: F.substring(t, 1, 500)), "\n")


def extracted_steps(sides: DataFrame, make: Callable) -> DataFrame:
    """sides with main_steps, appendix_steps, missing_side and summary by a model; all null where it gives no object.

    Where both sides are missing the model is not asked, and there are no steps.
    """
    none = F.array().cast(_NONE)
    both = sides.where("missing_side = 'both'").withColumns({"main_steps": none, "appendix_steps": none, "summary": F.lit("")})
    prompt = F.concat_ws("\n", F.lit(_STEPS), F.lit("main:"), _listed(F.col("main")), F.lit("appendix:"), _listed(F.col("appendix")), F.lit("missing side:"), "missing_side")
    asked = sides.where("missing_side <> 'both'").withColumn("_v", F.try_parse_json(model.json_object(model.model_column(make, prompt))))
    read = lambda path, kind: F.try_variant_get("_v", path, kind)
    told = F.lower(F.coalesce(F.nullif(read("$.missing_side", "string"), F.lit("")), F.col("missing_side")))
    known = F.col("_v").isNotNull()
    asked = asked.withColumns({
        "main_steps": F.when(known, clean_steps(read("$.main_steps", _NONE))), "appendix_steps": F.when(known, clean_steps(read("$.appendix_steps", _NONE))),
        "summary": F.when(known, F.coalesce(read("$.summary", "string"), F.lit(""))),
        "missing_side": F.when(told.isin(*SIDES), told).otherwise(F.col("missing_side")),
    })
    return asked.drop("_v").unionByName(both)


def emergency_results(chunks: DataFrame, make: Callable, snippets: DataFrame | None = None) -> DataFrame:
    """(doc_id, verdict, score, confidence, findings, need_review, main_steps, appendix_steps, missing_side, summary, similarity).

    A document without any emergency word is uncertain (20) and no model is asked; so is one whose review fails (20),
    or gives no object (25). Steps that could not be read do not stop the review. snippets (doc_id, text) are the
    clauses that the review gets. Every model call is made once.
    """
    spark = chunks.sparkSession
    none = F.array().cast(_NONE)
    sides = written(spark, emergency_sides(chunks), "emergency-sides")
    steps = written(spark, extracted_steps(sides.where("relevant"), make), "emergency-steps")
    rows = steps if snippets is None else steps.join(snippets.select("doc_id", F.col("text").alias("_clauses")), "doc_id", "left")
    clauses = F.lit("") if snippets is None else F.coalesce("_clauses", F.lit(""))
    part = lambda name, value: F.concat(F.lit(f"{name}="), value)
    block = F.when(F.col("main_steps").isNotNull(), F.concat_ws(
        "\n", part("missing_side", F.col("missing_side")), part("summary", F.col("summary")), part("main_steps", F.to_json("main_steps")), part("appendix_steps", F.to_json("appendix_steps")))).otherwise("")
    prompt = F.concat_ws("\n", F.lit(_REVIEW), clauses, _listed(F.concat("main", "appendix")), block)
    asked = written(spark, rows.withColumn("_raw", model.model_column(make, prompt)), "emergency-review")
    typed = model.typed_results(asked.withColumn("_j", model.json_object(F.col("_raw"))), "_j")
    failed, silent = F.coalesce("_raw", F.lit("")) == "", F.col("_j").isNull()
    lost = failed | silent
    typed = typed.withColumns({
        "verdict": F.when(lost, "uncertain").otherwise(F.col("verdict")), "score": F.when(lost, 0).otherwise(F.col("score")).cast("long"),
        "confidence": F.when(failed, 20).when(silent, 25).otherwise(F.col("confidence")).cast("long"), "need_review": lost | (F.col("verdict") == "uncertain") | (F.col("confidence") < 50),
        "main_steps": F.coalesce("main_steps", none), "appendix_steps": F.coalesce("appendix_steps", none), "summary": F.coalesce("summary", F.lit("")),
    })
    names = ["doc_id", "verdict", "score", "confidence", "findings", "need_review", "main_steps", "appendix_steps", "missing_side", "summary"]
    told = compared_steps(typed.select(*names), "main_steps", "appendix_steps").select(*names, "similarity")
    kind = told.schema["findings"].dataType
    quiet = sides.where("not relevant").select(
        "doc_id", F.lit("uncertain").alias("verdict"), F.lit(0).cast("long").alias("score"), F.lit(20).cast("long").alias("confidence"), F.array().cast(kind).alias("findings"), F.lit(True).alias("need_review"),
        none.alias("main_steps"), none.alias("appendix_steps"), "missing_side", F.lit("").alias("summary"), F.lit(None).cast("double").alias("similarity"))
    return told.unionByName(quiet)
