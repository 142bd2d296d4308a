import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import model
from tidemark.operators import dimensions as d


def test_operators_by_role(spark):
    hooks = d.Hooks()
    ops = d.store_operators(hooks)
    chunks = spark.createDataFrame([("c1", ["A"]), ("c2", [])], "chunk_id string, dimensions array<string>")
    assert [r.chunk_id for r in ops.call("orchestrator", "get_chunks_by_dimension", chunks, dimension="A").collect()] == ["c1"]
    with pytest.raises(PermissionError):
        ops.call("orchestrator", "search_skills", chunks)
    hooks.on("pre_call", lambda name, options: {"dimension": "B"})
    hooks.on("post_call", lambda name, result: 1 / 0)
    assert ops.call("orchestrator", "get_chunks_by_dimension", chunks, dimension="A").count() == 0
    with pytest.raises(ValueError, match="unknown event"):
        hooks.on("x", print)


def test_catalogue_and_context(spark):
    assert d.catalogue(spark, "s1").count() == 8 and d.catalogue(spark, "s2").count() == 14 and d.catalogue(spark, "s2", vision=False).count() == 6
    df = spark.createDataFrame([("title: 图一\n prev_text: 前文: x", None), ("title: no", ("9", None, None, None, None, None))],
                               "c string, g struct<section_path:string,title:string,prev_heading:string,prev_text:string,next_heading:string,next_text:string>")
    got = [r.f for r in df.select(d.context_fields(F.col("c"), F.col("g")).alias("f")).collect()]
    assert (got[0].title, got[0].prev_text, got[1].section_path, got[1].title) == ("图一", "前文: x", "9", "")


def test_model_dimensions(spark):
    rows = [("a", i, "text", f"row {i}" + (" bad" if i == 12 else "")) for i in range(25)] + [("b", 0, "text", "fine"), ("c", 0, "image", "bad")]
    chunks = spark.createDataFrame(rows, "doc_id string, pos int, chunk_type string, content string")
    make = model.scripted_model({"bad": '{"verdict": "partial", "findings": [{"severity": "medium", "description": "x"}]}'}, default='{"verdict": "pass"}')
    results, findings = d.batch_model_results(chunks, ["text"], make, "review")
    got = {r.doc_id: (r.verdict, r.score, r.confidence) for r in results.collect()}
    assert got == {"a": ("partial", 8, 77), "b": ("pass", 12, 95), "c": ("pass", 12, 95)}
    assert [(r.doc_id, r.batch) for r in findings.collect()] == [("a", 1)]
    ruled = {r.doc_id: (r.verdict, r.confidence, r.relevant) for r in d.excerpt_model_results(chunks, ["bad"], make, "review").collect()}
    assert ruled["a"] == ("partial", 70, True) and ruled["b"] == ("uncertain", 20, False)


def test_sampled_rows_are_those_of_the_standard_generator(spark):
    rows = [(f"d{i % 3}", i, "key" if i % 4 == 0 else "other" if i % 4 < 3 else None) for i in range(60)] + [("one", 0, "key")]
    df = spark.createDataFrame(rows, "doc_id string, pos int, content string")
    got = {}
    for r in d.sampled_rows(df, F.col("content").contains("key"), 8).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append(r.pos)
    for doc in ("d0", "d1", "d2", "one"):
        draw = random.Random(42)
        hits = [p for x, p, c in rows if x == doc and c == "key"]
        rest = [p for x, p, c in rows if x == doc and c != "key"]
        draw.shuffle(hits)
        draw.shuffle(rest)
        assert got[doc] == hits[:8] + rest[: max(0, 8 - len(hits))]
