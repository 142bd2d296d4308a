"""Word segmentation of text without spaces: a lexicon learnt from the corpus, and best paths over it.

A word is a run of two to `max_chars` characters that is frequent, whose parts belong together (cohesion: for each
way to cut it, how much more often it occurs than its parts would meet by chance) and whose neighbours on both
sides are free (branching entropy). Everything is counted from n-grams, which tasks count before the shuffle. A text
is then cut along the path with the greatest sum of log probabilities; a character that starts no word stands alone.

Runs are of Chinese characters; other letters and digits are words by themselves. Null text has no words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.gram_index import GramIndex
from tidemark.operators.retrieval import token_search
from tidemark.session import written

#: Words of a lexicon at most: the most frequent, so that each task can hold it.
LEXICON = 1 << 18
MAX_CHARS, LEAST_COUNT, COHESION, ENTROPY = 4, 5, 2.0, 0.8
_RUN = regex.compile(r"[一-鿿]+")
_TOKEN = regex.compile(r"[一-鿿]+|[\p{L}\p{N}--[一-鿿]]+", regex.V1)
#: Stands for the end of a run among the neighbours of an n-gram.
_EDGE = "\x00"
#: Different n-grams that a task counts before it passes them on.
_HELD = 1 << 20


def gram_counts(docs: DataFrame, text: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """(gram, n): the n-grams of up to max_chars + 1 characters of all runs, ends of runs included as a character."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for frame in batches:
            for content in frame.iloc[:, 0]:
                for run in _RUN.findall(content or ""):
                    run = _EDGE + run + _EDGE
                    for size in range(1, max_chars + 2):
                        found.update(run[i : i + size] for i in range(len(run) - size + 1))
                if len(found) > _HELD:
                    yield pd.DataFrame({"gram": list(found.keys()), "n": list(found.values())})
                    found = Counter()
        if found:
            yield pd.DataFrame({"gram": list(found.keys()), "n": list(found.values())})

    return docs.select(F.col(text).cast("string")).mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def lexicon(
    docs: DataFrame, text: str, max_chars: int = MAX_CHARS, least_count: int = LEAST_COUNT, cohesion: float = COHESION, entropy: float = ENTROPY, most: int = LEXICON
) -> DataFrame:
    """(word, n, cohesion, entropy): the words of a corpus, cohesion in natural logarithms, entropy the lesser of both sides."""
    spark = docs.sparkSession
    grams = written(spark, gram_counts(docs, text, max_chars), "grams")
    inner = grams.where(~F.col("gram").contains(_EDGE))
    total = inner.where(F.length("gram") == 1).agg(F.sum("n")).first()[0] or 1
    words = inner.where((F.col("n") >= least_count) & F.length("gram").between(2, max_chars)).select(F.col("gram").alias("word"), "n")
    # every cut of a word: both parts are n-grams as frequent as it or more
    cuts = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    cuts = cuts.select("word", "n", F.expr("substring(word, 1, at)").alias("a"), F.expr("substring(word, at + 1)").alias("b"))
    part = inner.where(F.col("n") >= least_count)
    met = cuts.join(part.select(F.col("gram").alias("a"), F.col("n").alias("na")), "a").join(part.select(F.col("gram").alias("b"), F.col("n").alias("nb")), "b")
    bond = met.groupBy("word").agg(F.min(F.log(F.col("n") * F.lit(float(total)) / (F.col("na") * F.col("nb")))).alias("cohesion")).where(F.col("cohesion") >= cohesion)

    def branching(side: str, word: Column, neighbour: Column) -> DataFrame:
        rows = grams.where(F.length("gram") >= 3).select(word.alias("word"), neighbour.alias("c"), "n").where(~F.col("word").contains(_EDGE))
        # each end of a run counts as a neighbour of its own
        n = F.sum("n")
        own = F.sum(F.when(F.col("c") != _EDGE, F.col("n") * F.log("n")).otherwise(0.0))
        return rows.groupBy("word").agg((F.log(n) - own / n).alias(side))

    left = branching("left", F.expr("substring(gram, 2)"), F.expr("substring(gram, 1, 1)"))
    right = branching("right", F.expr("substring(gram, 1, length(gram) - 1)"), F.expr("substring(gram, -1)"))
    found = words.join(bond, "word").join(left, "word").join(right, "word").withColumn("entropy", F.least("left", "right"))
    return found.where(F.col("entropy") >= entropy).orderBy(F.desc("n"), "word").limit(most).select("word", "n", "cohesion", "entropy")


@dataclass
class Segmenter:
    """Best-path segmentation over a lexicon of (word, count); built once in a worker as a trie."""

    words: dict[str, int]
    trie: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        total = sum(self.words.values()) + 1
        self.alone = -math.log(total) - 2.0
        for word, n in self.words.items():
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = math.log(n / total)

    def cut(self, run: str) -> list[str]:
        """The words of one run; of equal paths the one whose last words are longer."""
        best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
        for i in range(len(run)):
            base, node = best[i], self.trie
            if base + self.alone > best[i + 1]:
                best[i + 1], back[i + 1] = base + self.alone, i
            for j in range(i, len(run)):
                node = node.get(run[j])
                if node is None:
                    break
                gain = node.get("")
                if gain is not None and base + gain > best[j + 1]:
                    best[j + 1], back[j + 1] = base + gain, i
        out, j = [], len(run)
        while j:
            out.append(run[back[j] : j])
            j = back[j]
        return out[::-1]

    def tokens(self, text: str | None) -> list[str]:
        """All words of a text in order, in lower case."""
        found = []
        for m in _TOKEN.finditer((text or "").lower()):
            found += self.cut(m[0]) if "一" <= m[0][0] <= "鿿" else [m[0]]
        return found

    def column(self, text: Column) -> Column:
        """The words of a column of texts."""

        @F.pandas_udf("array<string>")
        def cut(texts: pd.Series) -> pd.Series:
            return texts.map(self.tokens)

        return cut(text)


def segmenter(words: DataFrame) -> Segmenter:
    """A segmenter over a lexicon of `LEXICON` words at most."""
    rows = words.select("word", "n").limit(LEXICON).toPandas()
    return Segmenter(dict(zip(rows["word"], rows["n"].astype(int), strict=True)))


def or_query(text: Column, cutter: Segmenter) -> Column:
    """The words of two characters and more of a query, each once, as the OR query of a text index."""
    return F.array_join(F.array_distinct(F.filter(cutter.column(text), lambda w: F.length(w) > 1)), " OR ")


def segmented_search(queries: DataFrame, index: GramIndex, q: str, query: str, key: str, k: int, cutter: Segmenter, most: int | None = None) -> DataFrame:
    """(q, key, rank, fallback): the first k documents that hold any segmented word of a query."""
    words = F.array_distinct(F.filter(cutter.column(F.col(query)), lambda w: F.length(w) > 1))
    return token_search(queries, index, q, query, key, k, most=most, words=words)
