"""Lexical and vector search, and the fusion of their ranks."""

from __future__ import annotations

from collections import Counter
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import gram_index
from tidemark.operators.gram_index import GramIndex
from tidemark.operators.sequence import top

#: Rank fusion: score is the sum of 1 / (RRF_K + rank).
RRF_K = 60
#: Vectors of a block of queries and of a part of the rows; scores that a task holds at once.
BLOCK_VECTORS, PART_VECTORS, SCORES = 4096, 16384, 1 << 20
#: Where all rows are queries: numbers of a part of the rows and of a block of queries; so many blocks at least, if each has `LEAST_VECTORS`.
PART_NUMBERS, BLOCK_NUMBERS, LEAST_BLOCKS, LEAST_VECTORS = 1 << 22, 1 << 20, 12, 1024


def tokens(text: Column, least: int = 3) -> Column:
    """Words of a query that are long enough, without the operators' names; the whole query if none is."""
    words = F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) >= least) & ~F.upper(w).isin("OR", "AND", "NOT"))
    whole = F.when(F.length(F.regexp_replace(text, r"\s", "")) >= least, F.array(F.trim(text))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.size(words) > 0, words).otherwise(whole))


def contains_search(queries: DataFrame, index: GramIndex, q: str, phrase: str, key: str) -> DataFrame:
    """(q, key): documents that hold a query's phrase, in any case. A phrase of under three characters is not searched."""
    wanted = queries.select(q, F.lower(phrase).alias("phrase")).where(F.length("phrase") >= 3)
    found = gram_index.find(index, wanted.select("phrase"))
    return wanted.join(found, "phrase").select(q, F.col("key").alias(key))


def bm25(queries: DataFrame, docs: DataFrame, q: str, query_text: str, key: str, text: str, k: int, k1: float = 1.2, b: float = 0.75, places: int = 6) -> DataFrame:
    """(q, key, score, rank): the k best documents for each query by Okapi BM25 over lower-case words."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    terms = docs.select(key, F.explode(words(F.col(text))).alias("term"))
    length = docs.select(key, F.size(words(F.col(text))).alias("len"))
    stats = length.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    wanted = queries.select(q, F.explode(F.array_distinct(words(F.col(query_text)))).alias("term"))
    tf = terms.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row of statistics: broadcast by its size
    rows = wanted.join(df, "term").join(tf, "term").join(length, key).crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = rows.groupBy(q, key).agg(F.round(F.sum(gain), places).alias("score"))
    return top(scored, [q], [F.desc("score"), key], k)


def dense_topk(queries: DataFrame, vectors: DataFrame, q: str, query_vector: str, key: str, vector: str, k: int, places: int = 6, label: str | None = None) -> DataFrame:
    """(q, key, score, rank): the k nearest vectors by cosine, on request of the query's label only.

    Queries in blocks of about `BLOCK_VECTORS` meet the rows in parts of about `PART_VECTORS`, each pair of a block
    and a part as one group, so that no task holds more and nothing passes through the driver. A group keeps the k
    best of its part for each query. Null keys and vectors find nothing and are not found.
    """
    queries, vectors = queries.where(F.col(q).isNotNull() & F.col(query_vector).isNotNull()), vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    n_blocks, n_parts = max(1, -(-queries.count() // BLOCK_VECTORS)), max(1, -(-vectors.count() // PART_VECTORS))
    groups, kinds = _groups(queries, vectors, q, query_vector, key, vector, label, n_blocks, n_parts)
    found = groups.applyInPandas(_nearest(k, places, label is not None), f"q {kinds[0]}, key {kinds[1]}, score double")
    return top(found, ["q"], [F.desc("score"), "key"], k).select(F.col("q").alias(q), F.col("key").alias(key), "score", "rank")


def dense_legs(queries: DataFrame, vectors: DataFrame, q: str, query_vector: str, key: str, vector: str, k: int, label: str, places: int = 6) -> DataFrame:
    """(q, key, leg, score, rank): the k nearest vectors by cosine of the query's label (leg 0) and of all (leg 1), from the same scores.

    For queries as many as the rows. Blocks and parts are as large as a task may hold by the width of the vectors, as
    every row travels once for each block, and a query and its best rows once for each part.
    """
    queries, vectors = queries.where(F.col(q).isNotNull() & F.col(query_vector).isNotNull()), vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    asked = queries.count()
    n_blocks, n_parts = max(1, -(-asked * width // BLOCK_NUMBERS), min(LEAST_BLOCKS, asked // LEAST_VECTORS)), max(1, -(-n * width // PART_NUMBERS))
    narrow = all(df.schema[c].dataType.simpleString() == "array<float>" for df, c in ((queries, query_vector), (vectors, vector)))
    groups, kinds = _groups(queries, vectors, q, query_vector, key, vector, label, n_blocks, n_parts, "array<float>" if narrow else "array<double>")
    found = groups.applyInPandas(_nearest_legs(k, places), f"q {kinds[0]}, key {kinds[1]}, leg int, score double")
    # all that follows goes by the query: one exchange
    best = top(found.repartition("q"), ["q", "leg"], [F.desc("score"), "key"], k)
    return best.select(F.col("q").alias(q), F.col("key").alias(key), "leg", "score", "rank")


def _groups(queries: DataFrame, vectors: DataFrame, q: str, query_vector: str, key: str, vector: str, label: str | None, n_blocks: int, n_parts: int, kind: str = "array<double>") -> tuple:
    """Blocks of queries beside parts of the rows, each pair as one group; the types of the ids."""
    labels = [] if label is None else [label]
    kinds = queries.schema[q].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    same = [F.col(c).alias("label") for c in labels]
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = queries.select(F.col(q).alias("q"), F.col(query_vector).cast(kind).alias("v"), *same).select(deal(n_blocks, "q", "v").alias("block"), all_of(n_parts).alias("part"), "*")
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast(kind).alias("v"), *same).select(deal(n_parts, "key", "v").alias("part"), all_of(n_blocks).alias("block"), "*")
    return mine.groupBy("block", "part").cogroup(rows.groupBy("block", "part")), kinds


def unit_rows(vectors: list, width: int | None = None) -> np.ndarray:
    """Vectors of length one as a matrix; a vector of zeros stays as it is."""
    matrix = np.array(vectors, dtype=np.float64).reshape(len(vectors), -1 if vectors else width or 0)
    length = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def best_of(names: list, wanted: np.ndarray, keys: np.ndarray, matrix: np.ndarray, k: int, places: int, same: tuple | None = None) -> list[tuple]:
    """(name, key, score): the k best rows of a matrix for each of the wanted vectors; equal scores go to the smaller key.

    Scores are made for some vectors at a time, `SCORES` numbers at most. `same`: labels of the wanted and of the rows.
    """
    out = []
    step = max(1, SCORES // max(1, len(keys)))
    for at in range(0, len(names), step):
        scores = np.round(wanted[at : at + step] @ matrix.T, places)
        for i, row in enumerate(scores, at):
            near = np.flatnonzero(same[1] == same[0][i]) if same else None
            row = row if near is None else row[near]
            # one more, as the query's own row does not count
            some = np.flatnonzero(row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1]) if len(row) > k + 1 else np.arange(len(row))
            near = some if near is None else near[some]
            best = sorted((s, x) for s, x in zip((-row[some]).tolist(), keys[near].tolist(), strict=True) if x != names[i])[:k]
            out += [(names[i], x, -s) for s, x in best]
    return out


def best_legs(names: np.ndarray, wanted: np.ndarray, keys: np.ndarray, matrix: np.ndarray, k: int, places: int, same: tuple) -> tuple[np.ndarray, ...]:
    """(name, key, leg, score) as columns: the k best rows of a wanted vector's label (leg 0) and of all (leg 1); equal scores go to the smaller key.

    Scores are made with single precision, `SCORES` numbers at most, and what may be among the best by them is
    scored anew with double precision. Rows and wanted vectors go by their labels, so that those of a label are a slice.
    """
    # a query's own rows do not count; a key may have several
    need = k + max(Counter(keys.tolist()).values())
    rows, mine = _first_copies(keys, matrix, same[1], need), np.argsort(same[0], kind="stable")
    rows = rows[np.argsort(same[1][rows], kind="stable")]
    keys, matrix, names, wanted, label = keys[rows], matrix[rows], names[mine], wanted[mine], same[0][mine]
    low, high = (np.searchsorted(same[1][rows], label, side) for side in ("left", "right"))
    place = np.argsort(np.argsort(keys, kind="stable"))
    rough, rough_rows = wanted.astype(np.float32), matrix.astype(np.float32).T
    # what the roughness of two scores, and of the rounding, can hide
    slack = (matrix.shape[1] + 4) * float(np.finfo(np.float32).eps) + 2 * 10.0**-places
    out, step = [], max(1, SCORES // len(keys))
    for at in range(0, len(names), step):
        scores = rough[at : at + step] @ rough_rows
        picked = [(1, 0, 0, _largest(scores, need, slack))]
        starts = [0, *(np.flatnonzero(np.diff(label[at : at + step])) + 1).tolist(), len(scores)]
        for a, b in pairwise(starts):
            picked.append((0, a, low[at + a], _largest(scores[a:b, low[at + a] : high[at + a]], need, slack)))
        leg = np.concatenate([np.full(len(found[0]), n, dtype=np.int32) for n, _, _, found in picked])
        i = np.concatenate([found[0] + a for _, a, _, found in picked]) + at
        j = np.concatenate([found[1] + first for _, _, first, found in picked])
        others = keys[j] != names[i]
        leg, i, j = leg[others], i[others], j[others]
        exact = [np.einsum("nd,nd->n", wanted[i[x : x + 16384]], matrix[j[x : x + 16384]]) for x in range(0, len(i), 16384)]
        score = np.round(np.concatenate([np.empty(0), *exact]), places)
        order = np.lexsort((place[j], -score, leg, i))
        one = 2 * i[order] + leg[order]
        order = order[np.arange(len(one)) - np.searchsorted(one, one) < k]
        out.append((names[i[order]], keys[j[order]], leg[order], score[order]))
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))


def _first_copies(keys: np.ndarray, matrix: np.ndarray, labels: np.ndarray, need: int) -> np.ndarray:
    """Rows by their keys, without those that have `need` copies of the same label before them: no query has room for these."""
    rows, seen = [], Counter()
    for i in np.argsort(keys, kind="stable").tolist():
        copy = matrix[i].tobytes(), labels[i]
        seen[copy] += 1
        if seen[copy] <= need:
            rows.append(i)
    return np.array(rows)


def _largest(scores: np.ndarray, need: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `need` largest scores of each row, and of those less than `slack` below.

    The bound is the `need`-th largest maximum of slices of a row: so many scores reach it, and few others do.
    """
    n = scores.shape[1]
    width = max(1, min(128, n // (4 * need)))
    slices = n // width
    if slices <= need:
        return np.nonzero(np.ones(scores.shape, dtype=bool))
    most = scores[:, : slices * width].reshape(len(scores), slices, width).max(axis=2)
    bound = np.partition(most, slices - need, axis=1)[:, slices - need, None] - np.float32(slack)
    return np.divmod(np.flatnonzero(scores >= bound), n)


def _codes(mine: pd.Series, rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Labels as numbers; a missing one equals none of the other side."""
    codes = pd.factorize(pd.concat([mine, rows]))[0]
    return codes[: len(mine)], np.where(codes[len(mine) :] < 0, -2, codes[len(mine) :])


def _nearest_legs(k: int, places: int):
    """The k best rows of a part, of the same label and of all, for each query of a block."""

    def scan(mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["q", "key", "leg", "score"]
        if not len(mine) or not len(rows):
            return pd.DataFrame([], columns=names)
        found = best_legs(mine["q"].to_numpy(), unit_rows(mine["v"].tolist()), rows["key"].to_numpy(), unit_rows(rows["v"].tolist()), k, places, _codes(mine["label"], rows["label"]))
        return pd.DataFrame(dict(zip(names, found, strict=True)))

    return scan


def _nearest(k: int, places: int, labelled: bool):
    """The k best rows of a part for each query of a block."""

    def scan(mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(mine) and len(rows):
            same = _codes(mine["label"], rows["label"]) if labelled else None
            found = best_of(mine["q"].tolist(), unit_rows(mine["v"].tolist()), rows["key"].to_numpy(), unit_rows(rows["v"].tolist()), k, places, same)
        return pd.DataFrame(found, columns=["q", "key", "score"])

    return scan


def fuse(legs: list[DataFrame], q: str, key: str, k: int, weights: list[float] | None = None, places: int = 9) -> DataFrame:
    """(q, key, score, rank): ranked legs (q, key, rank) fused; ties go to the earlier leg, then its rank."""
    weights = weights or [1.0] * len(legs)
    rows = None
    for i, (leg, w) in enumerate(zip(legs, weights, strict=True)):
        part = leg.select(q, key, F.lit(i).alias("leg"), "rank", (F.lit(w) / (RRF_K + F.col("rank"))).alias("gain"))
        rows = part if rows is None else rows.unionByName(part)
    return _fused(rows, q, key, k, places)


def fuse_legs(ranked: DataFrame, q: str, key: str, k: int, places: int = 9) -> DataFrame:
    """(q, key, score, rank): as `fuse`, of the legs of one table (q, key, leg, rank)."""
    return _fused(ranked.select(q, key, "leg", "rank", (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("gain")), q, key, k, places)


def _fused(rows: DataFrame, q: str, key: str, k: int, places: int) -> DataFrame:
    fused = rows.groupBy(q, key).agg(F.round(F.sum("gain"), places).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    return top(fused, [q], [F.desc("score"), "first", key], k).select(q, key, "score", "rank")


def prefer_filtered(ranked: DataFrame, q: str, hit: Column, least: int = 2) -> DataFrame:
    """Rows that pass a filter, or all rows of a query where fewer than `least` pass."""
    w = Window.partitionBy(q)
    return ranked.withColumn("_hit", hit).withColumn("_n", F.count_if(F.col("_hit")).over(w)).where(F.col("_hit") | (F.col("_n") < least)).drop("_hit", "_n")
