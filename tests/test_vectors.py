"""Latent vectors against a full decomposition, the vector index against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import search, vectors

SF = "/root/testdata/sf0.01"
TOPICS = ["valve pump pressure flow pipe leak", "wage contract office staff training shift", "fire alarm rescue drill smoke exit", "river soil bridge crossing bank depth"]


def test_latent_directions_as_a_full_decomposition(spark):
    draw = random.Random(1)
    texts = [" ".join(draw.choice(TOPICS[i % 4].split() + ["the", "of"]) for _ in range(20)) for i in range(80)] + [None, ""]
    space = vectors.latent_space(spark.createDataFrame([(t,) for t in texts], "t string"), "t", size=4, buckets=256, rounds=6)
    matrix = np.zeros((len(texts), 256))
    for i, t in enumerate(texts):
        at, n = vectors._cells_of(t, 256)
        matrix[i, at] = np.log1p(n) * space.weights[at]
    matrix = np.divide(matrix, np.linalg.norm(matrix, axis=1, keepdims=True), out=np.zeros_like(matrix), where=matrix.any(axis=1, keepdims=True))
    axes = np.linalg.svd(matrix, full_matrices=False)[2][:4].T
    # the same subspace: all cosines of the angles between them are near one
    assert np.linalg.svd(axes.T @ space.axes)[1].min() > 0.99
    held_out = [" ".join(draw.choice(TOPICS[i % 4].split()) for _ in range(8)) for i in range(40)]
    known, asked = np.array([space.encode(t) for t in texts[:80]]), np.array([space.encode(t) for t in held_out])
    assert ((asked @ known.T).argmax(axis=1) % 4 == np.arange(40) % 4).mean() >= 0.95
    assert not space.encode(None).any() and not space.encode("!!").any()
    got = spark.createDataFrame([("valve pump",)], "t string").select(space.column(F.col("t")).alias("v")).first().v
    assert np.allclose(got, space.encode("valve pump"))


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")


def test_recall_of_the_index_and_the_exact_search(spark, table):
    queries = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    truth = search.dense_topk(queries, table, "q", "qv", "vec_id", "embedding", 10).cache()
    index = vectors.build_index(table, "vec_id", "embedding", part_rows=20)
    assert index.rows.count() == table.count() and index.parts.max() > 1
    # these vectors have random directions, so that most cells are needed
    probes = vectors.tuned_probes(index, table, "vec_id", "embedding", 10)
    assert len(index.directions) // 2 < probes <= len(index.directions)
    found = vectors.index_topk(queries, index, "q", "qv", "vec_id", 10, probes=probes)
    assert vectors.recall(found, truth, "q", "vec_id") >= 0.9
    exact = vectors.index_topk(queries, index, "q", "qv", "vec_id", 10, probes=2, exact=True)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, truth.collect()))


def test_a_clustered_corpus_probes_few_cells(spark):
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((12, 16))
    rows = [(f"v{i:04d}", (centres[i % 12] + 0.1 * draw.standard_normal(16)).tolist()) for i in range(600)] + [("null", None), (None, [0.0] * 16), ("zero", [0.0] * 16)] + [(f"copy{i}", [1.0] * 16) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    index = vectors.build_index(df, "k", "v", cells=13, part_rows=100)
    queries = df.where("k like 'v%0'").select(F.col("k").alias("q"), F.col("v").alias("qv"))
    truth = search.dense_topk(queries, df, "q", "qv", "k", "v", 5).cache()
    assert vectors.tuned_probes(index, df, "k", "v", 5) <= 3
    found = vectors.index_topk(queries, index, "q", "qv", "k", 5, probes=2)
    assert vectors.recall(found, truth, "q", "k") >= 0.95
    assert index.parts.max() >= 3 and index.rows.count() == 901


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, v array<double>")
    index = vectors.build_index(none, "k", "v")
    assert vectors.index_topk(none.select(F.col("k").alias("q"), F.col("v").alias("qv")), index, "q", "qv", "k", 3).count() == 0
    space = vectors.latent_space(none.select(F.col("k").alias("t")), "t", size=2, buckets=64, rounds=1)
    assert not space.encode("word").any()


def test_probes_leave_the_task_in_slices(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PROBES", 100)
    n = 20
    index = vectors.VectorIndex(None, np.eye(n), np.ones(n), np.full(n, 2), "")
    caught = {}

    class Asked:
        sparkSession = spark

        def mapInArrow(self, scan, ddl):
            caught["scan"] = scan

    vectors._probes(index, Asked(), "long", lambda angles, radius, floors: angles >= 0)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([[1.0] * n] * 50), pa.array([0] * 50, pa.int32())], ["q", "qv", "block"])
    out = list(caught["scan"](iter([batch])))
    assert max(b.num_rows for b in out) <= 100 and sum(b.num_rows for b in out) == 50 * n * 2
    assert len({tuple(r.values()) for b in out for r in b.select(["cell", "part", "q"]).to_pylist()}) == 50 * n * 2


def test_blocks_of_queries_as_one(spark, monkeypatch):
    draw = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(x) for x in draw.standard_normal(4)]) for i in range(300)], "k long, v array<double>")
    asked = rows.where("k % 5 = 0").select(F.col("k").alias("q"), F.col("v").alias("qv"))
    index = vectors.build_index(rows, "k", "v", part_rows=20)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    got = vectors.index_topk(asked, index, "q", "qv", "k", 3, probes=2, exact=True)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in search.dense_topk(asked, rows, "q", "qv", "k", "v", 3).collect()}
