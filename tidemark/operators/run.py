"""Whole reviews: two explorers and a critic over a corpus, and resumable runs whose state is a table.

A run is a list of stages (a dimension and what evaluates it). Each stage is committed by itself, as rows of
(doc_id, verdict, ...) below state/dimension=.../attempt=...: a run that starts again reads what is there, does
only what is missing or failed, and a document's error is kept with it and ends no one else's work.
"""

from __future__ import annotations

import traceback
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import model
from tidemark.operators import folds, raters
from tidemark.operators.gram_index import GramIndex
from tidemark.operators.retrieval import context_rows, context_text
from tidemark.operators.similarity import verified_evidence
from tidemark.session import written

Ask = Callable[[], Callable[[str], str]]
STATE = f"doc_id string, verdict string, score long, confidence long, findings array<{raters.FINDING}>, need_review boolean, error string"
#: Shortest reference that is verified, and how many of an answer are.
LEAST_REF, REFS = 11, 3


def verified_refs(answers: DataFrame, chunks: DataFrame, index: GramIndex) -> DataFrame:
    """(doc_id, dimension, verified): whether an answer's references are in its document.

    References are evidence_refs, or else the findings' evidence, of more than ten characters; of the first three
    half, and one at least, must be found. An answer without any counts as verified.
    """
    refs = F.when(F.size("evidence_refs") > 0, F.col("evidence_refs")).otherwise(F.transform("findings", lambda f: f["evidence"]))
    first = F.slice(F.filter(refs, lambda r: F.length(r) >= LEAST_REF), 1, REFS)
    rows = answers.select("doc_id", "dimension", first.alias("refs"))
    stated = rows.select("doc_id", "dimension", F.posexplode("refs").alias("i", "evidence"))
    stated = stated.withColumn("finding_id", F.concat_ws("\x1f", "doc_id", "dimension", F.col("i").cast("string")))
    stated = written(answers.sparkSession, stated, "refs")
    found = verified_evidence(stated.select("finding_id", "doc_id", "evidence"), chunks, index)
    counted = stated.join(found, "finding_id").groupBy("doc_id", "dimension").agg((F.count_if("found") >= F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 2))).alias("verified"))
    return rows.select("doc_id", "dimension").join(counted, ["doc_id", "dimension"], "left").select("doc_id", "dimension", F.coalesce("verified", F.lit(True)).alias("verified"))


def two_plus_one(chunks: DataFrame, dims: DataFrame, index: GramIndex, explorer_a: Ask, explorer_b: Ask, critic: Ask, objective: tuple[str, ...] = (), budget: int | None = None) -> DataFrame:
    """(doc_id, dimension, verdict, score, confidence, findings, selected_from, evidence_verified, need_review): each dimension of each document.

    Context, then both explorers, the check of their evidence, and the critic, who is asked twice; where it fails,
    the explorers are merged by rule. Dimensions of `objective` have no first explorer. chunks: doc_id, chunk_id,
    pos, title, content, dimensions; index: of chunks by chunk_id, scope doc_id. Each answer is asked for once.
    """
    spark = chunks.sparkSession
    key = ["doc_id", "dimension"]
    context = context_text(context_rows(chunks, dims.select("dimension"), budget))
    prompt = F.concat_ws("\n", F.lit("dimension:"), "dimension", "text")
    skip = F.col("dimension").isin(*objective) if objective else F.lit(False)
    asked = context.select(*key, "text", F.when(skip, F.lit("")).otherwise(model.model_column(explorer_a, F.concat(F.lit("explorer a\n"), prompt))).alias("_a"),
                           model.model_column(explorer_b, F.concat(F.lit("explorer b\n"), prompt)).alias("_b"))
    asked = written(spark, asked, "explorers")
    fields = ("verdict_hint", "score_hint", "confidence", "findings", "evidence_refs", "reasoning")
    rows = asked
    for side in ("a", "b"):
        answers = model.explorer_answers(asked.select(*key, model.json_object(F.col(f"_{side}")).alias("_j")), "_j")
        answers = written(spark, answers.select(*key, *fields), f"answers-{side}")
        packed = answers.select(*key, F.struct(*fields).alias(side))
        rows = rows.join(packed, key).join(verified_refs(answers, chunks, index).withColumnRenamed("verified", f"{side}_verified"), key)
    sides = [F.concat(F.lit(f"{s}: "), F.substring(F.to_json(F.struct(s, f"{s}_verified")), 1, 3000)) for s in ("a", "b")]
    ruled = rows.withColumn("_c", model.model_column(lambda: model.with_retry(_object_or_error(critic()), 1), F.concat_ws("\n", F.lit("critic"), prompt, *sides)))
    ruled = written(spark, ruled.withColumn("_c", model.json_object(F.col("_c"))), "critic")
    out = [*key, "verdict", "score", "confidence", "findings", "selected_from", "evidence_verified", "need_review"]
    both = F.col("a_verified") & F.col("b_verified")
    told = raters.critic_results(ruled.where("_c is not null").drop("text"), "_c")
    told = told.withColumn("evidence_verified", both).withColumn("need_review", F.col("need_review") | ~both)
    merged = raters.fallback_merge(ruled.where("_c is null"))
    kinds = {"score": "long", "confidence": "long"}
    pick = lambda df: df.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in out])
    return pick(told).unionByName(pick(merged))


def _object_or_error(ask: Callable[[str], str]) -> Callable[[str], str]:
    def call(prompt: str) -> str:
        answer = ask(prompt)
        if model.first_json_object(answer) is None:
            raise ValueError("no JSON object in the answer")
        return answer

    return call


def captured(chunks: DataFrame, evaluate: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """(doc_id, verdict, score, confidence, findings, need_review, error) from a function of one document's rows.

    A document whose evaluation raises is uncertain with its error, and asks for a review.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row = {"doc_id": str(group["doc_id"].iloc[0]), "verdict": "uncertain", "score": 0, "confidence": 10, "findings": [], "need_review": True, "error": None}
        try:
            row |= evaluate(group.sort_values("pos"))
        except Exception as error:
            row["error"] = "".join(traceback.format_exception_only(error)).strip()[:500]
        return pd.DataFrame([row])

    return chunks.groupBy("doc_id").applyInPandas(run, STATE)


@dataclass(frozen=True)
class Stage:
    """A dimension, the group it runs in, and its evaluation of the rows of some documents."""

    dimension: str
    evaluate: Callable[[DataFrame], DataFrame]
    group: int = 0


def state_of(spark: SparkSession, folder: str) -> DataFrame:
    """(dimension, attempt, doc_id, ...): the last row of each document and dimension of all attempts so far."""
    schema = f"{STATE}, dimension string, attempt long"
    try:
        rows = spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/dimension=*")
    except AnalysisException:  # nothing has been done yet
        rows = spark.createDataFrame([], schema)
    names = [c for c in rows.columns if c not in ("doc_id", "dimension")]
    last = rows.groupBy("doc_id", "dimension").agg(F.max_by(F.struct(*names), "attempt").alias("r"))
    return last.select("doc_id", "dimension", "r.*")


def resumed(chunks: DataFrame, stages: list[Stage], folder: str) -> DataFrame:
    """The state after every stage has done what was left of it; failed documents are tried again.

    A stage's rows are written under a name of their own and then count as one: until the write has committed,
    readers see nothing of it, and a run that was killed does that stage again and nothing before it.
    """
    spark = chunks.sparkSession
    docs = chunks.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    for stage in sorted(stages, key=lambda s: s.group):
        state = state_of(spark, folder).where(F.col("dimension") == stage.dimension)
        work = docs.join(state.where("error is null").select("doc_id"), "doc_id", "left_anti")
        if work.isEmpty():
            continue
        attempt = (state.agg(F.max("attempt")).first()[0] or 0) + 1
        mine = chunks.join(work, chunks.doc_id.cast("string") == work.doc_id, "left_semi")
        found = stage.evaluate(mine)
        columns = [c.split()[0] for c in STATE.split(", ")]
        if "error" not in found.columns:
            found = found.withColumn("error", F.lit(None).cast("string"))
        rows = work.join(found.select(F.col("doc_id").cast("string"), *columns[1:]), "doc_id", "left")
        silent = F.col("verdict").isNull()
        rows = rows.withColumns({
            "error": F.when(silent, "no result").otherwise(F.col("error")), "verdict": F.coalesce("verdict", F.lit("uncertain")), "score": F.coalesce(F.col("score").cast("long"), F.lit(0)),
            "confidence": F.coalesce(F.col("confidence").cast("long"), F.lit(10)), "need_review": F.coalesce("need_review", F.lit(True)) | silent,
        })
        rows.select(*columns).write.parquet(f"{folder}/dimension={stage.dimension}/attempt={attempt}/{uuid.uuid4().hex}")
    return state_of(spark, folder)


def summary(state: DataFrame) -> DataFrame:
    """(doc_id, done, failed, verdict, need_review): a run by document; the strictest verdict stands for all."""
    strict = F.max_by("verdict", folds.strictness(F.col("verdict")))
    return state.groupBy("doc_id").agg(F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"), strict.alias("verdict"), F.bool_or("need_review").alias("need_review"))


def reviewed(prompt: Column, make: Ask) -> Column:
    """A model's answer as the JSON object in it, asked again once; null where there is none."""
    return model.json_object(model.model_column(lambda: model.with_retry(_object_or_error(make()), 1), prompt))
