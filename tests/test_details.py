"""Projections, defaults, parts of files and providers that no query reaches."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.plans import events
from tidemark.functions import model
from tidemark.operators import consistency, contest, raters
from tidemark.operators import store as merges
from tidemark.sources import parsed, registry, sinks, store
from tidemark.streaming import trace

FINDING = "struct<severity:string,description:string,evidence:string,anchor_text:string,paragraph_index:int,chunk_id:string,section_path:string>"


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        ("d1", "C1", "fail", [("high", "x", "proof " * 9, "", 4, "c1", "2.1"), ("low", "y", None, "anchor text that is longer than thirty characters", -1, None, "")]),
        ("d1", "E2", "pass", []), ("d2", "C1", "pass", None),
    ]
    return spark.createDataFrame(rows, f"doc_id string, dimension string, verdict string, findings array<{FINDING}>")


def test_locations_evidence_and_sparse_json(spark, results):
    rows = {(r.doc_id, r.dimension): r.locations for r in contest.with_locations(results).collect()}
    first, second = rows["d1", "C1"]
    assert (first.dimension, first.severity, first.page_number, first.highlight) == ("C1", "high", 5, ("proof " * 9)[:30])
    assert (second.page_number, second.highlight) == (None, "anchor text that is longer than thirty characters"[:30])
    assert rows["d1", "E2"] == [] and rows["d2", "C1"] is None
    one = results.where("dimension = 'C1' and doc_id = 'd1'").select(F.explode("findings").alias("f"))
    got = one.select(contest.sparse_json(F.col("f"), ["severity", "evidence", "section_path", "paragraph_index"]).alias("j"), contest.evidence(F.col("f")).alias("e")).collect()
    assert json.loads(got[0].j) == {"severity": "high", "evidence": "proof " * 9, "section_path": "2.1", "paragraph_index": "4"}
    assert json.loads(got[1].j) == {"severity": "low", "paragraph_index": "-1"}
    assert (got[0].e.text, got[0].e.chunk_id, got[0].e.section_path) == ("proof " * 9, "c1", "2.1")


def test_opinions_as_a_section(spark, results):
    text = {r.doc_id: r.text for r in contest.opinions_section(contest.opinions(results.where("findings is not null"))).collect()}
    assert text == {"d1": "- C1 (fail): x; y\n- E2 (pass): "}


def test_parts_of_a_parsed_file(spark):
    parts = spark.createDataFrame([("a", 1, 0, 9, None), ("a", 0, 1, 2, "early"), ("a", 0, 0, 1, "early"), ("b", 0, 0, 1, None), ("a", 2, 0, 20, "late")], "doc_id string, part int, pos int, page int, summary string")
    merged = [(r.doc_id, r.pos, r.page) for r in registry.merged_parts(parts.drop("summary")).orderBy("doc_id", "pos").collect()]
    assert merged == [("a", 0, 1), ("a", 1, 2), ("a", 2, 9), ("a", 3, 20), ("b", 0, 1)]
    assert {r.doc_id: r.summary for r in registry.merged_summary(parts.select("doc_id", "part", "summary")).collect()} == {"a": "early", "b": None}


def test_images_with_what_surrounds_them(spark):
    blocks = spark.createDataFrame([("d", 0, "heading", "1 Site"), ("d", 1, "paragraph", "a map"), ("d", 2, "image", ""), ("d", 3, "paragraph", "below"), ("d", 4, "image", ""), ("e", 0, "image", "")], "doc_id string, pos int, block_type string, text string")
    got = {(r.doc_id, r.pos): (r.prev_heading, r.prev_text, r.next_text, r.image_type) for r in registry.image_inventory(blocks, F.when(F.col("prev_text").contains("map"), "map").otherwise("other")).collect()}
    assert got == {("d", 2): ("1 Site", "a map", "below", "map"), ("d", 4): ("1 Site", "below", None, "other"), ("e", 0): (None, None, None, "other")}


def test_store_details(spark, tmp_path):
    skills = spark.createDataFrame([("s1", "A", 3), ("s2", "A", 9), ("s0", "A", 3), ("s3", "B", 99)], "skill_id string, dimension string, used_count int")
    assert [r.skill_id for r in store.most_used(skills, "A").collect()] == ["s2", "s0", "s1"]
    filled = store.with_defaults(skills.withColumn("note", F.when(F.col("skill_id") == "s1", "kept")), {"note": "none", "active": True}).collect()
    assert {r.skill_id: (r.note, r.active) for r in filled} == {"s1": ("kept", True), "s2": ("none", True), "s0": ("none", True), "s3": ("none", True)}
    merges.write_table(skills, str(tmp_path / "t"), ["dimension"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4 and (tmp_path / "t" / "dimension=B").is_dir()
    many = spark.createDataFrame([("k", 1, "a"), ("k", None, "b"), ("n", None, "only")], "id string, v int, t string")
    assert {r.id: r.t for r in merges.upsert(many.limit(0), many, ["id"], "v").collect()} == {"k": "a", "n": "only"}
    row = sinks.result_json(skills.where("skill_id = 's1'")).first().json
    assert json.loads(row) == {"skill_id": "s1", "dimension": "A", "used_count": 3} and "\n" in row
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "one.md").write_text("# A\n\ntext", encoding="utf-8")
    (tmp_path / "notes" / "two.txt").write_text("no")
    assert [tuple(r) for r in parsed.read_markdown(spark, str(tmp_path / "notes")).collect()] == [("one", "# A\n\ntext")]


def test_restored_results(spark):
    labels = spark.createDataFrame([("d1", "A", "pass"), ("d1", "B", "fail"), ("d2", "A", "pass")], "doc_id string, dimension string, verdict string")
    state = spark.createDataFrame([("d1", ["B", "B"]), ("d2", []), ("d3", None)], "doc_id string, completed array<string>")
    assert [tuple(r) for r in raters.restored(labels, state).collect()] == [("d1", "B", "fail")]


def test_role_numbers(spark):
    pattern = next(iter(consistency.ROLE_NUMBERS.items()))
    rows = spark.createDataFrame([("nothing here",), (None,)], "t string").select(consistency.role_numbers(F.col("t")).alias("m")).collect()
    assert [dict(r.m) if r.m is not None else None for r in rows][0] == {} and isinstance(pattern[0], str)


def test_vision_answers(spark):
    def make():
        def look(content, prompt):
            if content == b"bad":
                raise ValueError
            return f'{prompt} {{"bytes": {len(content)}}}'

        return look

    files = spark.createDataFrame([("a.png", bytearray(b"12345")), ("b.png", bytearray(b"bad")), ("c.png", None)], "path string, content binary")
    assert {r.path: r.analysis for r in model.described_images(files, make, "see").collect()} == {"a.png": '{"bytes": 5}', "b.png": None, "c.png": '{"bytes": 0}'}


def test_http_provider():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Authorization"], body["model"], body["messages"][0]["content"]))
            if "fail" in seen[-1][2]:
                self.send_error(500)
                return
            data = json.dumps({"choices": [{"message": {"content": "answer"}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        ask = model.provider({"kind": "http", "url": f"http://127.0.0.1:{server.server_port}", "model": "m", "timeout": 5})()
        assert ask("hello") == "answer" and seen == [("Bearer ", "m", "hello")]
        with pytest.raises(Exception, match="500"):
            ask("fail")
        assert len(seen) == 2  # an answer of the server is not asked for again
    finally:
        server.shutdown()
    closed = model.http_model(f"http://127.0.0.1:{server.server_port}", "m", timeout=1, retries=1)()
    server.server_close()
    with pytest.raises(OSError):
        closed("x")


def test_progress_counts(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 7, "purchase"), (2, "2024-01-01 00:00:05", 7, "error"), (3, "2024-01-01 00:00:09", 8, "purchase")]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumns({"ts": F.col("ts").cast("timestamp"), "value": F.lit(0.0), "props": F.lit(None).cast("string")}).write.parquet(str(tmp_path / "in"))
    q = trace.progress(trace.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("task_progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.user_id: (r.done, r.failed) for r in spark.table("task_progress").collect()} == {7: (1, 1), 8: (1, 0)}


def test_date_order_rules_join_in_tasks_of_so_many_rows(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    expected = sorted(tuple(r) for r in events.date_order_rules(spark, sf).collect())
    monkeypatch.setattr(events, "TASK_ROWS", 500)
    found = events.date_order_rules(spark, sf)
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert found.rdd.getNumPartitions() >= spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500
