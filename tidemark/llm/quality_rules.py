"""Quality rules with adaptive thresholds (DataFrame functions only).

Each document gets counts of words, word characters, symbols, repeated lines and words in repeated
three-word windows. Two base rules reject outright: under `min_words` words, or over `max_repeat_percent`
per cent of the words in repeated windows. The other limits are not fixed: for each language and source
the ratios of the documents that pass the base rules are gathered in quantile sketches (log-spaced bins
with counts, so that sketches of any two parts merge by adding counts; a quantile is off by a relative
`ACCURACY` at most), and a document is rejected where a ratio lies beyond its group's median by more than
`FENCE` interquartile ranges. A group of fewer than `MIN_GROUP` documents uses the merged sketch of its
language, a small language that of all documents.

Null or empty text has no words and fails the base rules. Null language or source is a group of its own
together with the empty string. Repeated rows each get a verdict; other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._common import WORD_SPLIT, scratch

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

ACCURACY = 0.01
_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
FENCE, MIN_GROUP = 5.0, 50
#: Ratio -> the least distance of a limit from the median, so that a group without spread keeps its own.
RATIOS = {"symbols": 0.1, "dup_lines": 0.5, "repeats": 0.2, "word_length": 1.0}
#: Ratios with a lower limit as well.
TWO_SIDED = ("word_length",)
_ZERO_BIN = -1_000_000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_counts(df: DataFrame, text: Column) -> DataFrame:
    """df with the base counts and n_lines, each a long, and base_failed added."""
    plain = [F.col(f"`{c}`") for c in df.columns]
    words = F.filter(F.split(F.col("_t"), WORD_SPLIT), lambda w: w != "")
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.translate(x, SPACES, "") != "")
    step = df.select(*plain, F.coalesce(text.cast("string"), F.lit("")).alias("_t"))
    step = step.select(*plain, "_t", words.alias("_w"), lines.alias("_l"))
    n = F.size("_w")
    # the three-word windows, equal ones side by side, each with its place
    windows = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
            F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))),
    )
    step = step.select(*plain, "_t", "_l", n.cast("long").alias("n_words"), F.sort_array(windows).alias("_s"))
    twin = lambda x, k: (F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"])
    again = F.filter(F.transform("_s", lambda x, k: F.when(F.coalesce(twin(x, k), F.lit(False)), x["i"])), lambda i: i.isNotNull())
    step = step.select(*plain, "_t", "_l", "n_words", again.alias("_r"))
    spread = F.array_distinct(F.flatten(F.transform("_r", lambda i: F.array(i, i + 1, i + 2))))
    count = lambda c: c.cast("long")
    counts = F.struct(
        F.col("n_words"),
        count(F.length(F.translate("_t", SPACES, ""))).alias("word_chars"),
        count(F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).alias("n_symbols"),
        count(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        count(F.coalesce(F.size(spread), F.lit(0))).alias("n_repeat_words"),
        count(F.size("_l")).alias("n_lines"),
    )
    # Generated rather than projected: a filter on the counts would otherwise be moved below, and take
    # every expression above with it into the lambdas, to be computed again for each word.
    step = step.select(*plain, F.explode(F.array(counts)).alias("_c")).select(*plain, "_c.*")
    too_repetitive = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return step.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | too_repetitive)


def ratio_columns() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def _bin(x: Column) -> Column:
    return F.when(x <= 0, F.lit(_ZERO_BIN)).otherwise(F.ceil(F.log(x) / math.log(_GAMMA)).cast("int"))


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group: n and, for each ratio, its lower and upper limit."""
    ordered = Window.partitionBy(*by, "ratio").orderBy("bin")
    ranked = sketch.groupBy(*by, "ratio", "bin").agg(F.sum("n").alias("n"))
    ranked = ranked.select(
        *by, "ratio", "n",
        F.when(F.col("bin") == _ZERO_BIN, 0.0).otherwise(2 * F.pow(F.lit(_GAMMA), F.col("bin")) / (1 + _GAMMA)).alias("value"),
        F.sum("n").over(ordered).alias("upto"),
        F.sum("n").over(Window.partitionBy(*by, "ratio")).alias("total"),
    )
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(q * (F.col("total") - 1)), F.col("value")))
    quartiles = ranked.groupBy(*by, "ratio").agg(F.max("total").alias("n"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    floor = F.create_map(*[F.lit(x) for pair in RATIOS.items() for x in pair])[F.col("ratio")]
    reach = F.greatest(FENCE * (F.col("q3") - F.col("q1")), floor)
    limits = quartiles.select(*by, "ratio", "n", (F.col("q2") - reach).alias("lo"), (F.col("q2") + reach).alias("hi"))
    pick = lambda name, side: F.max(F.when(F.col("ratio") == name, F.col(side))).alias(f"{side}_{name}")
    sides = [(r, "hi") for r in RATIOS] + [(r, "lo") for r in TWO_SIDED]
    return limits.groupBy(*by).agg(F.max("n").alias("n"), *[pick(r, side) for r, side in sides])


def thresholds(counts: DataFrame, lang: str = "_lang", source: str = "_source") -> DataFrame:
    """(lang, source, limits): the limits that hold for each language and source, from rows of with_counts."""
    pairs = F.array(*[F.struct(F.lit(r).alias("ratio"), _bin(c).alias("bin")) for r, c in ratio_columns().items()])
    # kept small before anything else happens: a row for each group, ratio and bin
    sketch = (
        counts.where(~F.col("base_failed"))
        .select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.explode(pairs).alias("_p"))
        .groupBy("_lang", "_source", F.col("_p.ratio").alias("ratio"), F.col("_p.bin").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sketch = scratch(counts.sparkSession, sketch, "quality-sketches")
    names = [f"hi_{r}" for r in RATIOS] + [f"lo_{r}" for r in TWO_SIDED]
    own = _quantiles(sketch, ["_lang", "_source"])
    by_lang = _quantiles(sketch, ["_lang"]).select("_lang", F.col("n").alias("n_lang"), *[F.col(x).alias(f"lang_{x}") for x in names])
    overall = _quantiles(sketch.withColumn("_all", F.lit(1)), ["_all"]).first()  # a few numbers
    joined = own.join(by_lang, "_lang")
    every = lambda x: F.lit(overall[x] if overall else None)
    choose = lambda x: F.when(F.col("n") >= MIN_GROUP, F.col(x)).when(F.col("n_lang") >= MIN_GROUP, F.col(f"lang_{x}")).otherwise(every(x).cast("double"))
    # written, so that the join reads a table of known size and a hot group can be split
    return scratch(counts.sparkSession, joined.select("_lang", "_source", *[choose(x).alias(x) for x in names]), "quality-limits")


def within_limits() -> Column:
    """The verdict of the method on a row with counts and limits."""
    tests = [c <= F.col(f"hi_{r}") for r, c in ratio_columns().items()]
    tests += [ratio_columns()[r] >= F.col(f"lo_{r}") for r in TWO_SIDED]
    verdict = tests[0]
    for t in tests[1:]:
        verdict = verdict & t
    return F.coalesce(verdict, F.lit(False))


def _groups(df: DataFrame, lang: str, source: str) -> list[Column]:
    return [F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source")]


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, the base counts, base_failed, kept) of every row."""
    rows = df.select(F.col(id_col).alias("doc_id"), *_groups(df, lang, source), F.col(text_col).alias("_text"))
    counts = scratch(df.sparkSession, with_counts(rows, F.col("_text")).drop("_text"), "quality-counts")
    judged = counts.join(thresholds(counts), ["_lang", "_source"], "left")
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & within_limits()).alias("kept"))


def keep_good(df: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of df that are kept, with its columns.

    The rows that pass the base rules are written with their counts, so that nothing is counted twice and
    no text is shuffled.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *_groups(df, lang, source))
    counted = scratch(df.sparkSession, with_counts(rows, F.col(f"_row.`{text_col}`")).where(~F.col("base_failed")), "quality-counted")
    limits = thresholds(counted)
    return counted.join(limits, ["_lang", "_source"]).where(within_limits()).select("_row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and verdict of every row of `documents`."""
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
