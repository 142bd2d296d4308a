"""The search layer with string ids, nulls, no hits, empty tables and very common phrases."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.model import first_json_object
from tidemark.operators import gram_index, retrieval, search
from tidemark.queries import QUERIES


def hits(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    words = ["Valve", "valve", "pump", "pipe", "é", "管道", "巡线管道", "a", "of", "PRESSURE", "x\ny", "tank's", "ß", "İ", "zz"]
    rows = [(f"d{i:03d}", " ".join(draw.choice(words) for _ in range(draw.randint(0, 9)))) for i in range(120)]
    return rows + [("d500", None), (None, "valve pump"), ("d501", ""), ("d502", "v"), ("d503", "nul\0byte")]


@pytest.fixture(scope="module")
def index(spark, texts):
    return gram_index.build(spark.createDataFrame(texts, "k string, t string"), "k", "t", segment_chars=600)


PHRASES = ["valve", "pump pipe", "管道", "线管", "a", "of", "sure", "tank's pump", "nowhere", "l\0b", "\0", "x\ny", "zz", "e v", "é"]


def lower(spark, text):
    return spark.range(1).select(F.lower(F.lit(text))).first()[0]


def test_find_as_a_scan(spark, index, texts):
    low = {k: lower(spark, t) for k, t in texts if k is not None and t is not None}
    expected = sorted((p, k) for p in PHRASES for k, t in low.items() if p in t)
    df = spark.createDataFrame([(p,) for p in PHRASES] * 2, "phrase string")
    assert hits(gram_index.find(index, df)) == expected
    for k in (1, 3, 1000):
        first = sorted((p, key) for p in PHRASES for key in sorted(x for q, x in expected if q == p)[:k])
        assert hits(gram_index.find(index, df, k, first_slice=1)) == first
    assert index.rows.select("seg").distinct().count() > 3
    assert not [1 for r in index.postings.collect() if r.n != len(r.places) or list(r.places) != sorted(set(r.places))]


def test_restricted_search_counts_only_what_is_allowed(spark):
    docs = spark.createDataFrame([(i, f"common words {i}", f"s{i % 7}") for i in range(200)], "k long, t string, s string")
    index = gram_index.build(docs, "k", "t", "s", segment_chars=300)
    wanted = spark.createDataFrame([("q1", "common"), ("q2", "words 1"), ("q3", "common")], "q string, phrase string")
    allowed = spark.createDataFrame([("q1", "s3"), ("q2", "s0"), ("q2", "s1")], "q string, scope string")
    got = hits(gram_index.find(index, wanted, 4, ("q",), allowed, first_slice=1))
    assert got == [("q1", "common", k) for k in (3, 10, 17, 24)] + [("q2", "words 1", k) for k in (1, 14, 15, 105)]


def test_token_search_with_string_ids_and_fallbacks(spark, index):
    queries = spark.createDataFrame([("a", "nowhere PUMP"), ("b", "OR of it"), ("c", None), ("d", ""), ("e", "zz"), ("f", "zebra valve pump zebu")], "q string, t string")
    got = retrieval.token_search(queries, index, "q", "t", "k", 2).collect()
    found = {(r.q, r.rank): (r.k, r.fallback) for r in got}
    assert {q for q, _ in found} == {"a", "e", "f"}  # "of it" is searched whole and not found
    assert found["a", 1][1] is False and found["e", 1][1] is True
    first = retrieval.token_search(queries, index, "q", "t", "k", 2, first_token=True).collect()
    assert {r.q for r in first if r.fallback} == {"e"}


def test_clause_search_filters_first_and_falls_back_to_the_first_token(spark):
    rows = [("c1", "GB 1", "泵 规范", "压力 pressure", ["pump"]), ("c2", "GB 2", "阀", "valve closing", None), ("c3", "GB 2", None, "xy z", ["tag"])]
    clauses = spark.createDataFrame(rows, "clause_id string, standard_name string, title string, content string, tags array<string>")
    index = retrieval.clause_index(clauses)
    queries = spark.createDataFrame([(1, "pressure valve"), (2, "xy nothing here"), (3, "pump")], "q int, t string")
    got = {(r.q, r.clause_id, r.fallback) for r in retrieval.clause_search(queries, index, "q", "t").collect()}
    assert got == {(1, "c1", False), (1, "c2", False), (2, "c3", True), (3, "c1", False)}
    allowed = spark.createDataFrame([(1, "GB 2"), (2, "GB 1"), (3, "GB 2")], "q int, standard_name string")
    got = {(r.q, r.clause_id, r.fallback) for r in retrieval.clause_search(queries, index, "q", "t", 3, allowed).collect()}
    assert got == {(1, "c2", False)}


def test_skill_search_by_substrings(spark):
    skills = spark.createDataFrame([("s1", "leak repair", "p1", "close the valve", 3, "E2"), ("s2", "marks", "valves", "check", 9, "C3"), ("s3", "n", "50% off", "u", 1, "C3")], "skill_id string, name string, pattern string, solution string, used_count int, dimension string")
    queries = spark.createDataFrame([(1, "VALVE x"), (2, "leak"), (3, "%"), (4, "nothing"), (5, "")], "q int, t string")
    assert [(r.q, r.skill_id, r.fallback) for r in retrieval.skill_search(queries, skills, "q", "t").orderBy("q", "rank").collect()] == [(1, "s2", False), (1, "s1", False), (2, "s1", False), (3, "s3", False)]
    assert [(r.q, r.skill_id) for r in retrieval.skill_search(queries, skills, "q", "t", 3, "E2").orderBy("q").collect()] == [(1, "s1"), (2, "s1")]


def test_empty_tables(spark, index):
    nothing = spark.createDataFrame([], "q string, t string")
    assert retrieval.token_search(nothing, index, "q", "t", "k", 3).count() == 0
    empty = gram_index.build(spark.createDataFrame([], "k string, t string"), "k", "t")
    queries = spark.createDataFrame([("a", "valve")], "q string, t string")
    assert retrieval.token_search(queries, empty, "q", "t", "k", 3).count() == 0
    assert search.contains_search(queries, empty, "q", "t", "k").count() == 0


def test_overlap_of_candidates(spark, index, texts):
    phrase = "valve pump pipe"
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    found = gram_index.candidates(index, spark.createDataFrame([(phrase,)], "phrase string"), 2).select("phrase", "seg", F.explode("places").alias("place"))
    got = {r.key: r.overlap for r in gram_index.overlap(index, found).join(index.rows, ["seg", "place"]).collect()}
    low = {k: t.lower() for k, t in texts if k and t}
    assert got and all(n == len(grams(phrase) & grams(low[k])) for k, n in got.items())


def test_dense_search_with_string_ids_nulls_and_ties(spark):
    rows = [("a", [1.0, 0.0], "x"), ("b", [2.0, 0.0], "x"), ("c", [0.0, 1.0], "y"), ("d", None, "x"), (None, [1.0, 1.0], "x"), ("e", [0.0, 0.0], None), ("f", [1.0, 1.0], "y")]
    vectors = spark.createDataFrame(rows, "k string, v array<double>, label string")
    queries = vectors.select(F.col("k").alias("q"), F.col("v").alias("qv"), "label")
    got = {(r.q, r["rank"]): (r.k, r.score) for r in search.dense_topk(queries, vectors, "q", "qv", "k", "v", 2).collect()}
    assert got["a", 1] == ("b", 1.0) and got["a", 2] == ("f", 0.707107) and got["c", 1] == ("f", 0.707107) and got["e", 1] == ("a", 0.0)
    assert {q for q, _ in got} == set("abcef")
    same = {(r.q, r.k) for r in search.dense_topk(queries, vectors, "q", "qv", "k", "v", 5, label="label").collect()}
    assert same == {("a", "b"), ("b", "a"), ("c", "f"), ("f", "c")}
    assert search.dense_topk(queries, vectors.limit(0), "q", "qv", "k", "v", 2).count() == 0
    assert search.dense_topk(queries.limit(0), vectors, "q", "qv", "k", "v", 2).count() == 0


@pytest.mark.parametrize("text, expected", [
    ('Answer: { see below {"verdict":"pass"}', '{"verdict": "pass"}'), ('{see {"verdict":"pass"}}', '{"verdict": "pass"}'), ('use {x} then { open {"a":1}', '{"a": 1}'),
    ('{"a":"}{"}', '{"a": "}{"}'), ('say "hi {" then {"b":2}', '{"b": 2}'), ('{"a":"\\"}"} {"z":1}', '{"a": "\\"}"}'), ("{" * 3000, None), (None, None), ("[1]", None),
])
def test_first_json_object(text, expected):
    assert first_json_object(text) == expected


def test_shared_trigrams_of_every_pair(spark):
    texts = [(1, "the whole passage"), (2, "whole"), (3, "a hole"), (4, "xy"), (5, None), (6, ""), (7, "ole ole ole"), (8, "nothing"), (8, "hole"), (9, "管道运行"), (10, "wh ole")]
    phrases = [(i, p) for i, p in enumerate(["whole", "hole", "xy", "ole ole ole", "管道运", "qqq", None, ""])] + [(100 + i, f"pass {i}") for i in range(300)]
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    expected = {}
    for q, p in phrases:
        for k, t in texts:
            if p and t and (n := len(grams(p) & grams(t))):
                old = expected.get((q, k), (0, False))
                expected[q, k] = (old[0] + n, old[1] or p in t)
    got = gram_index.shared_grams(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame(phrases, "q long, p string"), "q", "p")
    assert {(r.q, r.k): (r.overlap, r.contained) for r in got.collect()} == expected
    assert expected[0, 3] == (2, False) and expected[0, 1] == (3, True)


def test_passes_of_the_index(monkeypatch):
    monkeypatch.setattr(gram_index, "PASS_CHARS", 40)
    texts = ["abcabc", "", "é管道\0", "x" * 90, "abc", "b"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 9 + [1] * 9, pa.int32()), pa.array([*range(9), *range(9)], pa.int32()), pa.array(texts)], ["seg", "place", "text"])
    found = {}
    for out in gram_index._grams(iter([batch.slice(0, 5), batch.slice(5)])):
        for r in out.to_pylist():
            assert r["n"] == len(r["places"])
            found.setdefault((r["seg"], r["gram"]), []).extend(r["places"])
    expected = {}
    for i, t in enumerate(texts):
        for g in {(t + "\0\0")[j : j + 3] for j in range(len(t))}:
            expected.setdefault((i // 9, g), []).append(i % 9)
    assert found == expected
    names, offsets, docs = gram_index._packed([chr(40 + i) + "ab" for i in range(40000)] + ["".join(map(chr, [*range(40, 0xD800), *range(0xE000, 0x1E000)]))])
    assert len(names) == len(offsets) - 1 and offsets[-1] == len(docs) == len(set(zip(np.repeat(names, np.diff(offsets)).tolist(), docs.tolist())))


def test_blocks_and_parts_as_a_scan(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_VECTORS", 5)
    monkeypatch.setattr(search, "PART_VECTORS", 30)
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.standard_normal(4)], int(i % 3)) for i in range(200)] + [(900, [0.0] * 4, None), (901, None, 1), (None, [1.0] * 4, 1)]
    vectors = spark.createDataFrame(rows, "k long, v array<double>, label int")
    queries = vectors.where("k % 10 = 0").select(F.col("k").alias("q"), F.col("v").alias("qv"), "label")
    unit = {k: np.array(v) / (np.linalg.norm(v) or 1) for k, v, _ in rows if k is not None and v is not None}
    label = {k: x for k, _, x in rows}
    for named in (None, "label"):
        expected = set()
        for q in (x for x in unit if x % 10 == 0):
            near = sorted((-round(float(unit[q] @ unit[x]), 6), x) for x in unit if x != q and (not named or label[q] is not None and label[q] == label[x]))[:3]
            expected |= {(q, x, r + 1) for r, (_, x) in enumerate(near)}
        got = search.dense_topk(queries, vectors, "q", "qv", "k", "v", 3, label=named)
        assert {(r.q, r.k, r["rank"]) for r in got.collect()} == expected


def test_scores_are_made_for_some_vectors_at_a_time():
    matrix = search.unit_rows(list(np.random.default_rng(2).standard_normal((9000, 8))))
    tracemalloc.start()
    found = search.best_of(list(range(4000)), matrix[:4000], np.arange(9000), matrix, 2, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 8000 and peak < 64e6  # all scores are 288 MB


def test_phrases_in_blocks_as_a_scan(spark, index, texts, monkeypatch):
    monkeypatch.setattr(gram_index, "BLOCK_PHRASES", 4)
    low = {k: lower(spark, t) for k, t in texts if k is not None and t is not None}
    asked = ["valve", "sure", "nowhere", "é", "zz"]
    df = spark.createDataFrame([(p,) for p in [*asked, "", None]], "phrase string")
    assert hits(gram_index.find(index, df, 2)) == sorted((p, k) for p in asked for k in sorted(k for k, t in low.items() if p in t)[:2])


def test_every_vector_is_a_query_of_the_fusion(spark, tmp_path):
    draw = np.random.default_rng(8)
    rows = [(i, [float(x) for x in draw.standard_normal(4)], int(i % 3)) for i in range(1, 90)] + [(901, None, 1), (902, [1.0, 2.0, 0.5, 0.0], None), (903, [2.0, 4.0, 1.0, 0.0], 1), (None, [1.0] * 4, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = {k: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for k, v, _ in rows if k is not None and v is not None}
    label = {k: x for k, _, x in rows}
    expected = set()
    for q in unit:
        near = sorted((-round(float(unit[q] @ unit[x]), 6), x) for x in unit if x != q)
        legs = [[x for _, x in near if label[q] is not None and label[x] == label[q]][:10], [x for _, x in near][:10]]
        places = {}
        for leg, found in enumerate(legs):
            for rank, x in enumerate(found, 1):
                places.setdefault(x, []).append((leg, rank))
        fused = sorted((-round(sum(1 / (60 + rank) for _, rank in p), 9), min(p), x) for x, p in places.items())[:5]
        expected |= {(q, x, -s, rank) for rank, (s, _, x) in enumerate(fused, 1)}
    got = {(r.q_id, r.vec_id, r.score, r["rank"]) for r in QUERIES["rrf_fusion"](spark, str(tmp_path)).collect()}
    assert {q for q, *_ in got} == set(unit) and got == expected


@pytest.mark.parametrize("kind, key", [("float", "long"), ("double", "string")])
def test_legs_of_one_pass_equal_those_of_two(spark, monkeypatch, kind, key):
    monkeypatch.setattr(search, "PART_NUMBERS", 4 * 60)
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 4 * 30)
    draw = np.random.default_rng(6)
    name = (lambda i: i) if key == "long" else (lambda i: f"v{i}")
    rows = [(name(i), [float(x) for x in draw.standard_normal(4)], int(i % 7)) for i in range(120)] + [(name(200 + i), [1.0, 1.0, 0.0, 0.0], i % 2) for i in range(60)]
    rows += [(name(900), [0.0] * 4, None), (name(901), None, 1), (None, [1.0] * 4, 1)]
    vectors = spark.createDataFrame(rows, f"k {key}, v array<{kind}>, label int")
    queries = vectors.select(F.col("k").alias("q"), F.col("v").alias("qv"), "label")
    got = {tuple(r) for r in search.dense_legs(queries, vectors, "q", "qv", "k", "v", 4, "label").collect()}
    expected = set()
    for leg, named in enumerate(("label", None)):
        expected |= {(r.q, r.k, leg, r.score, r["rank"]) for r in search.dense_topk(queries, vectors, "q", "qv", "k", "v", 4, label=named).collect()}
    assert got == expected
    assert search.dense_legs(queries, vectors.limit(0), "q", "qv", "k", "v", 4, "label").count() == 0
    assert search.dense_legs(queries.limit(0), vectors, "q", "qv", "k", "v", 4, "label").count() == 0


def test_copies_of_a_key_leave_room_for_k_others():
    matrix = search.unit_rows([[1.0, 0.0]] * 3 + [[1.0, 0.1 * i] for i in range(1, 8)])
    keys = np.array([5, 5, 5, 0, 1, 2, 3, 4, 6, 7])
    same = np.zeros(1, dtype=int), np.zeros(10, dtype=int)
    _, found, leg, _ = search.best_legs(keys[:1], matrix[:1], keys, matrix, 2, 6, same)
    assert found.tolist() == [0, 1, 0, 1] and leg.tolist() == [0, 0, 1, 1]
