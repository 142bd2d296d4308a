"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token counts are raked: in turn the
weights are scaled so that the shares of the sources, the languages and the topics meet their targets,
until no margin is off by more than `TOLERANCE` (or `MAX_ROUNDS` times, where the
targets contradict each other). A cell's weight is the product of a factor of its source,
one of its language and one of its topic. The cells lie in Spark by source, whatever the number of
sources; a round is one pass over them that brings one number for each pair of language and topic to the
driver, where the factors of the languages and topics are scaled.

A document has rate * weight of its cell copies on average: the whole part of that for certain, and one
more with the probability of the rest, by a hash of its id, so that a run can be repeated. So it is in
the sample with the probability least(1, rate * weight), and `copies` times over where the weight asks for
more than the corpus has: with each document once at most, scarce sources, languages and topics would fall
short of their targets.

Targets are shares to the power of `TEMPER`, made to sum to one, unless given. The topic is a column, or
else the first of `TOPIC_SIGNS` that the text carries. Null source, language or topic counts with the empty
string; null or empty text is a document of no tokens (topic prose). Rows of one id share one decision. A
cell without tokens has the weight of its factors, 1 in a table without tokens. Only the named columns
are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import WORD_SPLIT, scratch

TEMPER, RATE, SEED = 0.7, 0.5, "mix-1"
#: Rounds go on until no margin is off its target by more than this share, or up to so many where targets contradict each other.
TOLERANCE, MAX_ROUNDS = 1e-4, 40
#: Topics by the first sign that a text carries, in this order; what has none is prose.
TOPIC_SIGNS = {"licence": ["Licensed under", "License"], "secrets": ["password=", "token ="], "contact": ["@"], "listing": [" | "]}
DIMS = ("source", "lang", "topic")


def topic(text: Column) -> Column:
    found = F.lit(None)
    for name, signs in TOPIC_SIGNS.items():
        found = F.coalesce(found, F.when(reduce(lambda a, b: a | b, [text.contains(s) for s in signs]), F.lit(name)))
    return F.coalesce(found, F.lit("prose"))


def n_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")).cast("long")


def cell_columns(df: DataFrame, text_col: str = "text", source: str = "source", lang: str = "lang", topic_col: str | None = None) -> DataFrame:
    """df with _source, _lang, _topic and _tokens."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumns({
        "_source": F.coalesce(F.col(source).cast("string"), F.lit("")),
        "_lang": F.coalesce(F.col(lang).cast("string"), F.lit("")),
        "_topic": topic(text) if topic_col is None else F.coalesce(F.col(topic_col).cast("string"), F.lit("")),
        "_tokens": n_tokens(text),
    })


def _by_source(cells: DataFrame, index: DataFrame, targets: DataFrame | None) -> DataFrame:
    """(_source, goal, pairs, tokens): a row for each source with its language and topic pairs, at most all there are."""
    own = cells.join(index, ["_lang", "_topic"]).groupBy("_source").agg(F.sort_array(F.collect_list(F.struct("pair", "tokens"))).alias("c"), F.sum("tokens").cast("double").alias("n"))
    if targets is not None:
        own = own.join(targets.withColumnRenamed("target", "goal"), "_source", "left")
    else:
        power = F.pow("n", F.lit(TEMPER))
        whole = own.agg(F.sum(power)).first()[0] or 1.0
        own = own.withColumn("goal", power / whole)
    doubles = F.transform("c", lambda x: x["tokens"].cast("double"))
    return scratch(cells.sparkSession, own.select("_source", F.col("goal").cast("double"), F.col("c.pair").alias("pairs"), doubles.alias("tokens")), "mix-sources")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Goal of each source; the pair, the tokens and the source of each of its cells."""
    pairs, tokens = batch.column(1), batch.column(2)
    size = np.diff(pairs.offsets.to_numpy())
    goal = batch.column(0).to_numpy(zero_copy_only=False)
    return goal, pairs.flatten().to_numpy(), tokens.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)


def _source_factor(goal: np.ndarray, mass: np.ndarray, grand: float) -> np.ndarray:
    """What meets the goals; 1 for sources without tokens or goal."""
    meets = (mass > 0) & ~np.isnan(goal)
    return np.where(meets, goal * grand / np.where(mass > 0, mass, 1.0), 1.0)


def _scaled(by_pair: np.ndarray, goal: np.ndarray, grand: float, factor: np.ndarray) -> np.ndarray:
    return np.where((by_pair > 0) & ~np.isnan(goal), factor * goal * grand / np.where(by_pair > 0, by_pair, 1.0), factor)


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """((_source, _lang, _topic, weight), residual): weights whose token shares meet the targets.

    targets: for each of DIMS a table (_<dim>, target) with shares that sum to one. The residual is the
    largest relative gap between a margin and its target.
    """
    spark, targets = cells.sparkSession, targets or {}
    found = cells.groupBy("_lang", "_topic").agg(F.sum("tokens").alias("n")).toPandas()  # a number for each language and topic
    found = found.sort_values(["_lang", "_topic"]).reset_index(drop=True)
    grand, n_pairs = float(found.n.sum()), len(found)
    names, codes, goals = {}, {}, {}
    for dim in ("lang", "topic"):
        codes[dim], names[dim] = found[f"_{dim}"].factorize()
        if dim in targets:
            given = {r[f"_{dim}"]: r["target"] for r in targets[dim].collect()}
            goals[dim] = np.array([given.get(x, np.nan) for x in names[dim]], float)
        else:
            power = np.bincount(codes[dim], found.n.astype(float), len(names[dim])) ** TEMPER
            goals[dim] = power / (power.sum() or 1.0)
    index = spark.createDataFrame([(x, y, i) for i, (x, y) in enumerate(zip(found["_lang"], found["_topic"], strict=True))], "_lang string, _topic string, pair int")
    sources = _by_source(cells, index, targets.get("source"))

    def gather(now: np.ndarray, before: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mass, gap = np.zeros(n_pairs), 0.0
            for batch in batches:
                goal, pair, tokens, row = _flat(batch)
                total = np.bincount(row, tokens * now[pair], len(goal))
                was = np.bincount(row, tokens * before[pair], len(goal))
                held = (was > 0) & ~np.isnan(goal)
                gap = max(gap, float(np.abs(total[held] / was[held] - 1).max(initial=0.0)))
                mass += np.bincount(pair, _source_factor(goal, total, grand)[row] * tokens, n_pairs)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n_pairs)), pa.array(np.append(gap, mass))], ["pair", "mass"])

        sums = sources.select("goal", "pairs", "tokens").mapInArrow(run, "pair long, mass double").groupBy("pair").agg(F.sum("mass").alias("mass"), F.max("mass").alias("top")).toPandas()
        sums = sums.set_index("pair")
        return sums.mass.reindex(range(n_pairs), fill_value=0.0).to_numpy(), float(sums.top.get(-1, 0.0))

    factor = {dim: np.ones(len(names[dim])) for dim in names}
    before = now = np.ones(n_pairs)
    residual = np.inf
    by = lambda dim, values: np.bincount(codes[dim], values, len(names[dim]))
    for k in range(rounds + 1):
        mass, gap = gather(now, before)
        if k:
            residual = max(gap, lang_gap)
        if k == rounds or residual < tolerance:
            break
        for dim, other in (("lang", "topic"), ("topic", "lang")):
            factor[dim] = _scaled(by(dim, mass * factor[dim][codes[dim]] * factor[other][codes[other]]), goals[dim], grand, factor[dim])
        before, now = now, factor["lang"][codes["lang"]] * factor["topic"][codes["topic"]]
        reached = by("lang", mass * now)
        held = (reached > 0) & ~np.isnan(goals["lang"])
        lang_gap = float(np.abs(reached[held] / (goals["lang"][held] * grand) - 1).max(initial=0.0))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            goal, pair, tokens, row = _flat(batch.select(["goal", "pairs", "tokens"]))
            own = _source_factor(goal, np.bincount(row, tokens * before[pair], len(goal)), grand)
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(row)), pa.array(pair, pa.int32()), pa.array(own[row] * now[pair])], ["_source", "pair", "weight"])

    weights = sources.select("goal", "pairs", "tokens", "_source").mapInArrow(weigh, "_source string, pair int, weight double")
    return scratch(spark, weights.join(index, "pair").select("_source", "_lang", "_topic", "weight"), "mix-weights"), residual


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a hash of the key."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":" + seed)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(16**12))


def copies(key: Column, expected: Column) -> Column:
    """How often a document is in the sample: expected times on average, at least once where that is 1 or more."""
    whole = F.floor(expected)
    return whole + (uniform(key) < expected - whole).cast("long")


def _weighted(rows: DataFrame, targets: dict[str, DataFrame] | None, rate: float) -> DataFrame:
    """Rows of cell_columns with their weight and the expected number of their copies."""
    cells = scratch(rows.sparkSession, rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens")), "mix-cells")
    weights, _ = rake(cells, targets)
    return rows.join(weights, ["_source", "_lang", "_topic"]).withColumn("_expected", F.round(rate * F.col("weight"), 6))


def probabilities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "source", lang: str = "lang",
                  targets: dict[str, DataFrame] | None = None, rate: float = RATE, topic_col: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, topic, weight, expected, probability, copies, sampled) of every row."""
    topics = [] if topic_col is None else [F.col(topic_col).alias("_t")]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.col(source).alias("_s"), F.col(lang).alias("_l"), *topics)
    rows = cell_columns(rows, "_text", "_s", "_l", "_t" if topics else None).select("doc_id", "_source", "_lang", "_topic", "_tokens")
    n = copies(F.col("doc_id"), F.col("_expected"))
    return _weighted(rows, targets, rate).select(
        "doc_id", F.col("_tokens").alias("n_tokens"), F.col("_topic").alias("topic"), F.round("weight", 6).alias("weight"), F.col("_expected").alias("expected"),
        F.least(F.lit(1.0), "_expected").alias("probability"), n.alias("copies"), (n > 0).alias("sampled"),
    )


def drawn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "source", lang: str = "lang",
          targets: dict[str, DataFrame] | None = None, rate: float = RATE, topic_col: str | None = None) -> DataFrame:
    """(_row, _copies): the sampled rows of df, each once, with the number of their copies."""
    nested = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    rows = cell_columns(nested, f"_row.`{text_col}`", f"_row.`{source}`", f"_row.`{lang}`", topic_col and f"_row.`{topic_col}`")
    n = copies(F.col(f"_row.`{id_col}`"), F.col("_expected"))
    return _weighted(rows, targets, rate).select("_row", n.alias("_copies")).where("_copies > 0")


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "source", lang: str = "lang",
           targets: dict[str, DataFrame] | None = None, rate: float = RATE, topic_col: str | None = None) -> DataFrame:
    """The sampled rows of df with its columns, each as often as it has copies: its token shares meet the targets."""
    kept = drawn(df, id_col, text_col, source, lang, targets, rate, topic_col)
    return kept.select("_row", F.explode(F.expr("sequence(1L, _copies)"))).select("_row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated weight and the decision for every row of `documents`."""
    return probabilities(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def decision_sql(table: str) -> str:
    """DuckDB CTEs (of a recursive WITH) up to `decided`: the rows of the table with their weight and decision."""
    signs = " ".join(f"WHEN {' OR '.join(f'contains(t, {s!r})' for s in signs)} THEN '{name}'" for name, signs in TOPIC_SIGNS.items())
    ctes = [
        f"mixed AS (SELECT *, coalesce(source, '') AS source_, coalesce(lang, '') AS lang_, CASE {signs} ELSE 'prose' END AS topic_, "
        rf"len(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens "
        f"FROM (SELECT *, coalesce(text, '') AS t FROM {table}))",
        "cell0 AS MATERIALIZED (SELECT source_, lang_, topic_, sum(n_tokens)::DOUBLE AS tokens FROM mixed GROUP BY ALL)",
        "whole AS (SELECT sum(tokens) AS grand FROM cell0)",
    ]
    for dim in DIMS:
        ctes.append(f"goal_{dim} AS (SELECT {dim}_, p / sum(p) OVER () * grand AS goal_{dim} FROM "
                    f"(SELECT {dim}_, pow(sum(tokens), {TEMPER}) AS p FROM cell0 GROUP BY {dim}_), whole)")
    mass = lambda dim, w: f"sum(tokens * {w}) OVER (PARTITION BY {dim}_)"
    scaled = "cells"
    for k, dim in enumerate(DIMS):
        scaled = f"(SELECT *, CASE WHEN {mass(dim, f'w{k}')} = 0 THEN w{k} ELSE w{k} * goal_{dim} / {mass(dim, f'w{k}')} END AS w{k + 1} FROM {scaled})"
    gap = lambda dim: f"CASE WHEN {mass(dim, 'w3')} = 0 THEN 0 ELSE abs({mass(dim, 'w3')} / goal_{dim} - 1) END"
    columns = "source_, lang_, topic_, tokens, goal_source, goal_lang, goal_topic"
    ctes.append(
        f"cells AS (SELECT 0 AS k, {columns}, 1.0::DOUBLE AS w0, 1e9::DOUBLE AS gap FROM cell0 JOIN goal_source USING (source_) JOIN goal_lang USING (lang_) JOIN goal_topic USING (topic_) "
        f"UNION ALL SELECT k + 1, {columns}, w3, max(g) OVER () FROM (SELECT *, greatest({gap('source')}, {gap('lang')}) AS g FROM {scaled}) WHERE gap >= {TOLERANCE} AND k < {MAX_ROUNDS})")
    ctes.append("weights AS (SELECT source_, lang_, topic_, w0 AS weight FROM cells WHERE k = (SELECT max(k) FROM cells))")
    ctes.append(
        f"decided AS (SELECT *, floor(expected)::BIGINT + (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, 12))::BIGINT / {float(16**12)} < expected - floor(expected))::BIGINT AS copies "
        f"FROM (SELECT mixed.*, weight, round({RATE} * weight, 6) AS expected FROM mixed JOIN weights USING (source_, lang_, topic_)))")
    return ",\n".join(ctes)


OP5_SQL = (
    f"WITH RECURSIVE {decision_sql('documents')} SELECT doc_id, n_tokens, topic_ AS topic, round(weight, 6) AS weight, expected, least(1.0, expected) AS probability, "
    "copies, copies > 0 AS sampled FROM decided"
)
