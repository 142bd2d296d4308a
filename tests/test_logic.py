"""The logic dimension from rows to verdicts with scripted models."""

import json

from tidemark.operators import logic


def hint(verdict, *descriptions, **more):
    found = [{"id": f"x{i}", "severity": "high", "description": d, "quote_a": "one", "quote_b": "two"} for i, d in enumerate(descriptions)]
    return json.dumps({"verdict_hint": verdict, "score_hint": 5, "confidence_hint": 77, "summary": "s", "contradictions": found, **more})


ANSWERS = {
    "a": {"docA": hint("fail", "d1"), "docB": hint("fail", "d1"), "docC": hint("pass"), "docD": "no object", "docE": hint("partial", "d2")},
    "b": {"docA": "well { " + hint("fail", "d1"), "docB": hint("fail", "other"), "docC": hint("pass"), "docD": hint("pass"), "docE": hint("pass")},
    "critic": {"docB": '{"verdict":"partial","score":7,"confidence":66,"details":"why","findings":[{"severity":"low","description":"x","evidence":"y","rule_id":"z"}]}', "docE": "nothing"},
}


def model(side, log):
    def make():
        def ask(prompt):
            name = next(k for k in ("docA", "docB", "docC", "docD", "docE") if k in prompt)
            with open(log, "a") as f:
                f.write(f"{side} {name} {'clause' in prompt}\n")
            return ANSWERS[side][name]

        return ask

    return make


def test_rows_to_verdicts(spark, tmp_path):
    rows = [(f"doc{c}", i, "TEXT" if i else "heading", f"doc{c} row {i} 矛盾") for c in "ABCDE" for i in range(3)] + [("docF", 0, "image", "docF"), ("docG", 0, "text", " ")]
    chunks = spark.createDataFrame(rows, "doc_id string, pos int, chunk_type string, content string")
    snippets = spark.createDataFrame([("docA", "clause one")], "doc_id string, text string")
    log = tmp_path / "log"
    found = logic.logic_review(chunks, ["矛盾"], model("a", log), model("b", log), model("critic", log), snippets)
    got = {r.doc_id: r for r in found.collect()}
    short = {d: (r.verdict, r.score, r.confidence, r.path, r.need_review) for d, r in got.items()}
    assert short == {
        "docA": ("fail", 5, 77, "ab_merge", False), "docB": ("partial", 7, 66, "critic", False), "docC": ("pass", 5, 77, "ab_merge", False),
        "docD": ("uncertain", 0, 15, "none", True), "docE": ("uncertain", 0, 15, "none", True), "docF": ("uncertain", 0, 15, "none", True), "docG": ("uncertain", 0, 15, "none", True),
    }
    assert [(f.description, f.evidence, f.rule_id) for f in got["docA"].findings] == [("d1", "one | two", "x0")] and got["docB"].details == "why"
    asked = sorted(log.read_text().split("\n"))[1:]
    assert asked == sorted([f"{s} doc{c} {c == 'A'}" for s in "ab" for c in "ABCDE"] + ["critic docB False", "critic docE False"])  # each once, the critic only where they differ
    assert logic.logic_review(chunks.limit(0), ["x"], model("a", log), model("b", log), model("critic", log)).count() == 0
