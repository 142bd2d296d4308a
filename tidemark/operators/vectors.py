"""Vectors of texts by latent semantic analysis, and a vector index of inverted lists by cells.

**Vectors.** A text is its words hashed to `buckets`, weighted by frequency and inverse document frequency. The
leading right singular vectors of that matrix come from a randomised range finder: each round is one pass over
the texts that multiplies the sparse rows with a thin matrix and back, tasks sum their part of the product, and
the small factorisation runs on the driver. The thin matrix has buckets * (size + EXTRA) numbers whatever the
corpus, and so has what each task returns.

**Index.** Directions of cells are fitted by spherical k-means on a bounded sample (`SAMPLE_ROWS` rows by a hash of
their key); every row is then assigned to its nearest cell and written. A query probes its nearest cells; with
`exact` it also probes every cell whose radius allows a row better than the k-th found, which gives the exact
result. A cell of many rows is cut in parts of about `PART_ROWS`, so a cell with a third of all rows is no
single task. Null keys and vectors are not indexed; vectors of zeros have the score 0 with everything.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.search import best_of, dense_topk, unit_rows
from tidemark.operators.sequence import top
from tidemark.session import shared_folder, written

BUCKETS, SIZE, EXTRA, ROUNDS = 1 << 15, 32, 8, 3
SAMPLE_ROWS, PART_ROWS = 20_000, 16_384
#: Probes that a task makes at once, and queries of a group.
PROBES, BLOCK_QUERIES = 1 << 14, 1 << 14
#: Buckets of the thin matrix that are summed together.
BLOCK = 1024
_WORD = re.compile(r"[^\W_]+")


def _cells_of(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's words and how often each is."""
    words = _WORD.findall((text or "").lower())
    return np.unique(np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words)), return_counts=True)


@dataclass(frozen=True)
class LatentSpace:
    """The weight of each bucket, and its coordinates."""

    weights: np.ndarray
    axes: np.ndarray

    def encode(self, text: str | None) -> np.ndarray:
        """The unit vector of a text; zeros where no word is known."""
        at, n = _cells_of(text, len(self.weights))
        vector = (np.log1p(n) * self.weights[at]) @ self.axes[at] if len(at) else np.zeros(self.axes.shape[1])
        length = np.sqrt(vector @ vector)
        return vector / length if length > 1e-12 else np.zeros(len(vector))

    def column(self, text: Column) -> Column:
        """The vectors of a column of texts."""

        @F.pandas_udf("array<double>")
        def vectors(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: self.encode(t).tolist())

        return vectors(text)


def _summed(rows: DataFrame, scan, width: int, buckets: int) -> np.ndarray:
    """The sum over all tasks of a matrix (buckets, width): `scan` yields one for each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = scan(t for batch in batches for t in batch.column(0).to_pylist())
        for block in range(0, buckets, BLOCK):
            part = total[block : block + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.astype("<f8").tobytes()], pa.binary())], ["block", "part"])

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(p, "<f8") for p in group["part"]], axis=0)
        return pd.DataFrame({"block": [key[0]], "part": [total.tobytes()]})

    out = np.zeros((buckets, width))
    for r in rows.mapInArrow(task, "block long, part binary").groupBy("block").applyInPandas(add, "block long, part binary").collect():  # buckets / BLOCK rows
        part = np.frombuffer(r.part, "<f8").reshape(-1, width)
        out[r.block : r.block + len(part)] = part
    return out


def latent_space(docs: DataFrame, text: str, size: int = SIZE, buckets: int = BUCKETS, rounds: int = ROUNDS, seed: int = 1) -> LatentSpace:
    """The space of the `size` leading directions of all texts; fewer where the texts have fewer."""
    rows = docs.select(F.col(text).cast("string"))
    context = docs.sparkSession.sparkContext

    def frequencies(texts: Iterator[str | None]) -> np.ndarray:
        total = np.zeros((buckets, 2))
        for t in texts:
            total[_cells_of(t, buckets)[0], 0] += 1
            total[0, 1] += 1
        return total

    seen = _summed(rows, frequencies, 2, buckets)
    weights = np.where(seen[:, 0] > 0, np.log((1 + seen[0, 1]) / (1 + seen[:, 0])) + 1, 0.0)
    thin = np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, size + EXTRA)))[0]
    for _ in range(rounds):
        sent = context.broadcast((weights, thin))

        def product(texts: Iterator[str | None], sent=sent) -> np.ndarray:
            weight, matrix = sent.value
            total = np.zeros((buckets, matrix.shape[1]))
            for t in texts:
                at, n = _cells_of(t, buckets)
                row = np.log1p(n) * weight[at]
                length = np.sqrt(row @ row)
                if length:
                    row = row / length
                    total[at] += np.outer(row, row @ matrix[at])
            return total

        image = _summed(rows, product, thin.shape[1], buckets)
        values, turn = np.linalg.eigh(thin.T @ image)
        thin, before = np.linalg.qr(image @ turn[:, ::-1])[0], thin @ turn[:, ::-1]
        strength = values[::-1]
    keep = int((strength[:size] > 1e-9 * max(strength[0], 1e-300)).sum())
    return LatentSpace(weights, before[:, : max(keep, 1)])


@dataclass(frozen=True)
class VectorIndex:
    """rows: cell, part, key, vector; directions (cells, d); radius: the widest angle in each cell; parts of each cell."""

    rows: DataFrame
    directions: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    path: str


def fit_cells(vectors: DataFrame, key: str, vector: str, cells: int, rounds: int = 12, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Directions of cells, by spherical k-means over a sample of `sample_rows` rows."""
    drawn = vectors.select(vector, F.xxhash64(key).alias("_h")).orderBy("_h").limit(sample_rows).select(vector).toPandas()[vector]
    rows = unit_rows(drawn.tolist())
    rows = rows[(rows != 0).any(axis=1)] if len(rows) else rows
    if not len(rows):
        return np.zeros((1, rows.shape[1] if rows.ndim == 2 else 0))
    draw = np.random.default_rng(7)
    found = rows[draw.choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(rounds):
        nearest = (rows @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, rows)
        empty = np.bincount(nearest, minlength=len(found)) == 0
        sums[empty] = rows[draw.choice(len(rows), int(empty.sum()))]
        found = unit_rows(list(sums))
    return found


def build_index(vectors: DataFrame, key: str, vector: str, cells: int | None = None, part_rows: int = PART_ROWS, path: str | None = None) -> VectorIndex:
    """Fits cells on a sample, assigns every row and writes the lists."""
    spark = vectors.sparkSession
    path = path or f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    if cells is None:
        cells = int(min(4096, max(1, rows.count() ** 0.5)))
    directions = fit_cells(rows, "key", "vector", cells)
    sent = spark.sparkContext.broadcast(directions)  # 4096 directions at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = unit_rows(batch.column(1).to_pylist()) @ sent.value.T
                cell = score.argmax(axis=1)
                angle = np.arccos(np.clip(score[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle), *batch.columns], ["cell", "angle", "key", "vector"])

    kind = rows.schema["key"].dataType.simpleString()
    placed = written(spark, rows.mapInArrow(assign, f"cell int, angle double, key {kind}, vector array<double>"), "vector-cells")
    radius, parts = np.zeros(len(directions)), np.ones(len(directions), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # a row for each cell
        radius[r.cell], parts[r.cell] = r.radius, -(-r.n // part_rows)
    many = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell") + 1) if parts.max() > 1 else F.lit(1)
    listed = placed.select("cell", F.pmod(F.xxhash64("key", "vector"), many).cast("int").alias("part"), "key", "vector")
    listed.repartition("cell", "part").sortWithinPartitions("cell", "part").write.parquet(path)
    return VectorIndex(spark.read.schema(listed.schema).parquet(path), directions, radius, parts, path)


def _probes(index: VectorIndex, queries: DataFrame, kind: str, choose) -> DataFrame:
    """(cell, part, block, q, qv) for the cells that choose(angles (n, cells), floors) picks for each query.

    queries: q, qv, on request a floor, and the query's block last.
    """
    sent = queries.sparkSession.sparkContext.broadcast((index.directions, index.radius, index.parts))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, radius, parts = sent.value
        step = max(1, PROBES // max(1, int(parts.sum())))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            angles = np.arccos(np.clip(unit_rows(batch.column(1).to_pylist()) @ directions.T, -1, 1))
            floors = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 3 else None
            row, cell = np.nonzero(choose(angles, radius, floors))
            many = parts[cell]
            row, cell = np.repeat(row, many), np.repeat(cell, many)
            part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            take = pa.array(row)
            block = batch.column(batch.num_columns - 1).take(take)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), block, batch.column(0).take(take), batch.column(1).take(take)], ["cell", "part", "block", "q", "qv"])

    return queries.mapInArrow(scan, f"cell int, part int, block int, q {kind}, qv array<double>")


def index_topk(queries: DataFrame, index: VectorIndex, q: str, query_vector: str, key: str, k: int, probes: int = 8, exact: bool = False, places: int = 6) -> DataFrame:
    """(q, key, score, rank): the k nearest rows by cosine in the cells that each query probes; its own key does not count."""
    spark = queries.sparkSession
    stated = queries.where(F.col(q).isNotNull() & F.col(query_vector).isNotNull()).select(F.col(q).alias("q"), F.col(query_vector).cast("array<double>").alias("qv"))
    kinds = stated.schema["q"].dataType.simpleString(), index.rows.schema["key"].dataType.simpleString()

    def score(mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(rows):
            out = best_of(mine["q"].tolist(), unit_rows(mine["qv"].tolist()), rows["key"].to_numpy(), unit_rows(rows["vector"].tolist()), k, places)
        return pd.DataFrame(out, columns=["q", "key", "score"])

    def searched(asked: DataFrame) -> DataFrame:
        rows = index.rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        pairs = asked.groupBy("cell", "part", "block").cogroup(rows.groupBy("cell", "part", "block"))
        return pairs.applyInPandas(score, f"q {kinds[0]}, key {kinds[1]}, score double")

    def nearest(angles, radius, floors):
        limit = np.partition(angles, min(probes, angles.shape[1]) - 1, axis=1)[:, min(probes, angles.shape[1]) - 1]
        return angles <= limit[:, None]

    # a group holds the queries of one block that probe a part of a cell
    blocks = max(1, -(-stated.count() // BLOCK_QUERIES))
    mine = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block")
    found = searched(_probes(index, stated.select("q", "qv", mine), kinds[0], nearest))
    if exact:
        found = written(spark, found, "vector-probes")
        w = top(found, ["q"], [F.desc("score"), "key"], k)
        floors = w.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        # rounding may lift a score by half a unit of its last place
        rest = stated.join(floors, "q", "left").select("q", "qv", F.coalesce(F.col("floor") - 10.0**-places, F.lit(-2.0)).alias("floor"), mine)

        def others(angles, radius, floors):
            best = np.cos(np.maximum(angles - radius - 1e-7, 0))
            return (best >= floors[:, None]) & ~nearest(angles, radius, None)

        found = found.unionByName(searched(_probes(index, rest, kinds[0], others)))
    return top(found, ["q"], [F.desc("score"), "key"], k).select(F.col("q").alias(q), F.col("key").alias(key), "score", "rank")


def recall(found: DataFrame, truth: DataFrame, q: str, key: str) -> float:
    """The share of the true (q, key) that were found."""
    row = truth.select(q, key).join(found.select(q, key).withColumn("_f", F.lit(1)), [q, key], "left").agg(F.count("_f").alias("f"), F.count(F.lit(1)).alias("n")).first()
    return row.f / row.n if row.n else 1.0


def tuned_probes(index: VectorIndex, vectors: DataFrame, key: str, vector: str, k: int = 10, target: float = 0.95, sample: int = 128) -> int:
    """The fewest cells a query must probe to find `target` of its k nearest, measured on `sample` rows against all rows.

    Rows are drawn by a hash of their key. Where directions have no clusters this is most of the cells.
    """
    drawn = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(key), F.lit(1))).limit(sample)
    drawn = drawn.select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("qv"))
    truth = dense_topk(drawn, index.rows, "q", "qv", "key", "vector", k)
    cells = truth.join(index.rows.select("key", "cell"), "key").select("q", "cell").toPandas()  # sample * k rows
    if not len(cells):
        return 1
    asked = drawn.toPandas().drop_duplicates("q").set_index("q")
    order = np.argsort(np.argsort(-(unit_rows(asked["qv"].tolist()) @ index.directions.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(order[asked.index.get_indexer(cells["q"]), cells["cell"].to_numpy()])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1


def vector_store(spark: SparkSession, docs: DataFrame, key: str, text: str, space: LatentSpace, cells: int | None = None) -> VectorIndex:
    """The index of all texts in a latent space."""
    return build_index(docs.select(key, space.column(F.col(text)).alias("vector")), key, "vector", cells)
