"""A review from rows to verdicts with scripted models, and runs that are killed and start again."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.model import scripted_model
from tidemark.operators import gram_index, run

CHUNK = "doc_id string, chunk_id string, pos int, title string, content string, dimensions array<string>"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("d1", "d1-0", 0, "plan", "the emergency valve must be closed at once by the operator", ["E2"]),
        ("d1", "d1-1", 1, "staff", "four inspectors walk the section every single day", ["C3"]),
        ("d2", "d2-0", 0, None, "second document speaks about pressure tests of the pipe", ["E2"]),
    ]
    return spark.createDataFrame(rows, CHUNK)


def answer(verdict, evidence, severity="high", **more):
    return json.dumps({"verdict_hint": verdict, "score_hint": 6, "confidence": 80, "findings": [{"severity": severity, "description": f"finding {verdict}", "evidence": evidence, "rule_id": "r"}], **more})


def test_two_explorers_and_a_critic(spark, chunks):
    index = gram_index.build(chunks, "chunk_id", "content", "doc_id")
    dims = spark.createDataFrame([("E2",), ("C3",)], "dimension string")
    a = scripted_model({"emergency valve": "thinking { first " + answer("fail", "the emergency valve must be closed"), "pressure": answer("fail", "words that are nowhere at all in it")}, answer("partial", ""))
    b = scripted_model({"emergency valve": answer("partial", "invented evidence zzz qqq xxx"), "pressure": answer("pass", "pressure tests of the pipe", "low")}, answer("pass", "short"))
    critic = scripted_model({"four inspectors": '{"verdict": "pass", "score": 11, "confidence": 90, "selected_from": "B", "evidence_verified": true, "findings": []}'}, "the critic has no answer")
    got = {(r.doc_id, r.dimension): r for r in run.two_plus_one(chunks, dims, index, a, b, critic, budget=1000).collect()}
    assert set(got) == {("d1", "E2"), ("d1", "C3"), ("d2", "E2"), ("d2", "C3")}
    sure = got["d1", "C3"]
    assert (sure.verdict, sure.score, sure.selected_from, sure.evidence_verified, sure.need_review) == ("pass", 11, "B", True, False)
    first = got["d1", "E2"]  # b's evidence is not in the document: a is the base
    assert (first.verdict, first.confidence, first.selected_from, first.evidence_verified, first.need_review) == ("fail", 70, "merged", False, True)
    second = got["d2", "E2"]  # b's is, a's is not: a adds nothing
    assert (second.verdict, second.selected_from, [f.description for f in second.findings]) == ("pass", "B", ["finding pass"])
    alone = {(r.doc_id, r.dimension): r for r in run.two_plus_one(chunks, dims, index, a, b, critic, objective=("E2",), budget=1000).collect()}
    assert [f.description for f in alone["d1", "E2"].findings] == []  # the first explorer was not asked, the second not verified


def test_a_run_resumes_where_it_was_killed(spark, chunks, tmp_path):
    folder, seen = str(tmp_path / "state"), []

    def passing(df):
        seen.append(("rule", sorted(r.doc_id for r in df.select("doc_id").distinct().collect())))
        return df.groupBy("doc_id").agg(F.lit("pass").alias("verdict"), F.lit(9).alias("score"), F.lit(80).alias("confidence"), F.array().cast("array<struct<severity:string,description:string,evidence:string,rule_id:string>>").alias("findings"), F.lit(False).alias("need_review"))

    def killed(df):
        raise KeyboardInterrupt

    def one_fails(df):
        seen.append(("model", sorted(r.doc_id for r in df.select("doc_id").distinct().collect())))

        def evaluate(group):
            if "pressure" in group["content"].iloc[0]:
                raise ValueError("no answer from the service")
            return {"verdict": "fail", "score": 3, "confidence": 70, "need_review": False}

        return run.captured(df, evaluate)

    with pytest.raises(KeyboardInterrupt):
        run.resumed(chunks, [run.Stage("C5", killed, 2), run.Stage("C1", passing, 0)], folder)
    state = run.resumed(chunks, [run.Stage("C1", passing, 0), run.Stage("C5", one_fails, 2)], folder)
    rows = {(r.doc_id, r.dimension): (r.verdict, r.error, r.attempt) for r in state.collect()}
    assert seen == [("rule", ["d1", "d2"]), ("model", ["d1", "d2"])]  # the first stage was not done twice
    assert rows["d1", "C5"] == ("fail", None, 1) and rows["d2", "C5"] == ("uncertain", "ValueError: no answer from the service", 1)
    by_doc = {r.doc_id: (r.done, r.failed, r.verdict, r.need_review) for r in run.summary(state).collect()}
    assert by_doc["d1"] == (2, 0, "fail", False) and (by_doc["d2"][:2], by_doc["d2"][3]) == ((1, 1), True)

    seen.clear()
    state = run.resumed(chunks, [run.Stage("C1", passing), run.Stage("C5", passing)], folder)
    assert seen == [("rule", ["d2"])]  # only what had failed
    assert {(r.doc_id, r.dimension): (r.verdict, r.error, r.attempt) for r in state.collect()}["d2", "C5"] == ("pass", None, 2)


def test_documents_without_a_result_are_failures(spark, chunks, tmp_path):
    state = run.resumed(chunks, [run.Stage("X", lambda df: run.captured(df.where("doc_id = 'd1'"), lambda g: {"verdict": "pass"}))], str(tmp_path))
    assert {r.doc_id: (r.verdict, r.error) for r in state.collect()} == {"d1": ("pass", None), "d2": ("uncertain", "no result")}
    assert run.resumed(chunks.limit(0), [run.Stage("X", lambda df: df)], str(tmp_path / "none")).count() == 0
