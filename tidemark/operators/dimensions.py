"""Dimensions as a protocol, their catalogue, operators by name with permissions and hooks, and model dimensions."""

from __future__ import annotations

import random
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import model
from tidemark.lexicons import DIMENSION_CATALOGUE, OPERATOR_PERMISSIONS
from tidemark.operators import folds
from tidemark.operators.raters import fan_out
from tidemark.operators.sequence import placed_within, priority_budget

EVENTS = ("pre_call", "post_call", "pre_run", "post_run", "pre_commit", "post_batch")


class Dimension(Protocol):
    """An evaluator: rows of chunks to (doc_id, verdict, score, confidence) and findings."""

    name: str

    def run(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]: ...


class Hooks:
    """Callbacks by event; the last true answer counts, and a callback that fails has none."""

    def __init__(self) -> None:
        self._callbacks: dict[str, list[Callable]] = {e: [] for e in EVENTS}

    def on(self, event: str, callback: Callable) -> None:
        if event not in self._callbacks:
            raise ValueError(f"unknown event {event}")
        self._callbacks[event].append(callback)

    def fire(self, event: str, *args):
        answer = None
        for callback in self._callbacks[event]:
            try:
                answer = callback(*args) or answer
            except Exception:  # a hook never stops the run
                continue
        return answer


class Operators:
    """Operators over DataFrames by name; roles may call those that their list allows."""

    def __init__(self, hooks: Hooks | None = None, permissions: dict[str, list[str]] | None = None) -> None:
        self._operators: dict[str, Callable] = {}
        self.hooks = hooks or Hooks()
        self.permissions = OPERATOR_PERMISSIONS if permissions is None else permissions

    def register(self, name: str, operator: Callable) -> Callable:
        self._operators[name] = operator
        return operator

    def call(self, role: str, name: str, *args, **options):
        """The operator's result; hooks before and after it may put others in place of its options and result."""
        if name not in self.permissions.get(role, []):
            raise PermissionError(f"{role} may not call {name}")
        options = self.hooks.fire("pre_call", name, options) or options
        result = self._operators[name](*args, **options)
        changed = self.hooks.fire("post_call", name, result)
        return result if changed is None else changed


def store_operators(hooks: Hooks | None = None) -> Operators:
    """The operators over stored relations that raters may call."""
    from tidemark.operators import consistency, retrieval
    from tidemark.sources import store

    out = Operators(hooks)
    out.register("get_chunks_by_dimension", store.by_dimension)
    out.register("get_chunk_by_id", lambda chunks, ident: chunks.where(F.col("chunk_id") == ident))
    out.register("get_appendix", retrieval.appendix)
    out.register("search_chunks", retrieval.token_search)
    out.register("search_skills", retrieval.skill_search)
    out.register("fts_search", retrieval.clause_search)
    out.register("compare_emergency_steps", consistency.compared_steps)
    out.register("extract_numbers", lambda text: consistency.numbers_with_units(text))
    return out


def catalogue(spark: SparkSession, scenario: str, vision: bool = True) -> DataFrame:
    """(dimension, group, needs_images) of a scenario; without a vision model those on images are left out."""
    rows = [(name, group, images) for name, group, images in DIMENSION_CATALOGUE[scenario] if vision or not images]
    return spark.createDataFrame(rows, "dimension string, `group` string, needs_images boolean")


def context_fields(context: Column, given: Column | None = None) -> Column:
    """The fields of an image's context: those given, or else read from lines of `key: value`."""
    names = ("section_path", "title", "prev_heading", "prev_text", "next_heading", "next_text")
    read = {n: F.trim(F.regexp_extract(context, rf"(?m)^\s*{n}:(.*)$", 1)) for n in names}
    if given is None:
        return F.struct(*[c.alias(n) for n, c in read.items()])
    some = F.lit(False)
    for n in names:
        some = some | (F.coalesce(given[n], F.lit("")) != "")
    return F.struct(*[F.when(some, F.coalesce(given[n], F.lit(""))).otherwise(F.coalesce(read[n], F.lit(""))).alias(n) for n in names])


def sampled_rows(rows: DataFrame, hit: Column, most: int, seed: int = 42) -> DataFrame:
    """rows with `rank`: the first `most` of each document, those with `hit` first, both kinds shuffled by the seed.

    The order is that of the standard generator (Mersenne Twister) started with the seed for each document, which
    shuffles its hits and then its other rows, each in the order of `pos`. Only positions travel to the shuffle.
    """

    def shuffle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        draw = random.Random(seed)
        hits, rest = group[group["_hit"]]["pos"].tolist(), group[~group["_hit"]]["pos"].tolist()
        draw.shuffle(hits)
        draw.shuffle(rest)
        chosen = (hits[:most] + rest[: max(0, most - len(hits))])[:most]
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]] * len(chosen), "pos": chosen, "rank": range(1, len(chosen) + 1)})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "pos")}
    places = rows.select("doc_id", "pos", F.coalesce(hit, F.lit(False)).alias("_hit"))
    ranks = places.groupBy("doc_id").applyInPandas(shuffle, f"doc_id {kinds['doc_id']}, pos {kinds['pos']}, rank long")
    return rows.join(ranks, ["doc_id", "pos"])


def batched(rows: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, batch, content): the texts of a document's rows in batches, joined in order."""
    placed = placed_within(rows.select("doc_id", "pos", "content"), ["doc_id"], F.col("pos"), ["pos"], F.col("pos"))
    parts = placed.withColumn("batch", F.floor((F.col("rank") - 1) / size)).groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("r"))
    return parts.select("doc_id", "batch", F.array_join(F.transform("r", lambda x: x["content"]), "\n---\n").alias("content"))


def batch_model_results(chunks: DataFrame, types: list[str], make: Callable, instruction: str, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """A dimension that a model reviews in batches: (results, findings).

    The findings of all batches of a document are folded as language findings are; a batch without an
    answer has none.
    """
    rows = chunks.where(F.lower("chunk_type").isin(*types) & (F.trim("content") != ""))
    asked = batched(rows, size)
    answers = fan_out(asked, model.model_column(make, F.concat(F.lit(instruction + "\n"), "content")))
    findings = answers.select("doc_id", "batch", F.explode("findings").alias("f")).select("doc_id", "batch", "f.*")
    every = chunks.select("doc_id").distinct().join(findings.select("doc_id", "severity"), "doc_id", "left")
    return folds.severity_counts(every, ["doc_id"]).select("doc_id", *folds.language_verdict()), findings


def excerpt_model_results(chunks: DataFrame, words: list[str], make: Callable, instruction: str, max_rows: int = 40, max_chars: int = 6000) -> DataFrame:
    """A dimension that a model reviews by an excerpt: rows with its words first, within a budget.

    A document without any of the words is uncertain without being asked.
    """
    from tidemark.functions.text import any_of
    from tidemark.operators.retrieval import excerpt_text

    hit = any_of(F.col("content"), words)
    kept = priority_budget(chunks.where(F.trim("content") != ""), ["doc_id"], hit, ["pos"], max_rows, max_chars, "content")
    relevant = chunks.groupBy("doc_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("relevant"))
    work = relevant.join(excerpt_text(kept, ["doc_id"], "rn", "excerpt"), "doc_id", "left")
    prompt = F.when(F.col("relevant"), F.concat(F.lit(instruction + "\n"), "excerpt"))
    answers = fan_out(work, F.when(F.col("relevant"), model.model_column(make, F.coalesce(prompt, F.lit("")))).otherwise(""))
    return answers.select("doc_id", "relevant", "verdict", "score", F.when(F.col("relevant"), F.col("confidence")).otherwise(20).alias("confidence"), "findings", "need_review")
