"""The summary and the Markdown of a review."""

from tidemark.operators import report

RESULT = "doc_id string, dimension string, verdict string, score long, need_review boolean, findings array<struct<severity:string,description:string>>"
OPINION = "doc_id string, dimension string, pos int, severity string, verdict string, opinion string, suggestions array<string>"


def test_summary_and_markdown(spark):
    results = spark.createDataFrame([
        ("d1", "C1_structure", "fail", 4, True, [("low", "f-low"), ("high", "f-high")]), ("d1", "L2_plans", "pass", 12, False, []), ("d1", "X9", "pass", None, False, None),
        ("d2", "E2", "partial", 7, False, [("medium", "m"), ("high", "h"), (None, "n")]),
    ], RESULT)
    said = [("d1", "L2_plans", 1, "high", "pass", "fine", ["b", "a"]), ("d1", "C1_structure", 1, "high", "fail", "second", ["b", "", None]), ("d1", "C1_structure", 0, "medium", "partial", "first", None), ("d1", "L2_plans", 0, "low", "fail", "weak", [f"s{i:02d}" for i in range(12)])]
    opinions = spark.createDataFrame(said, OPINION)
    docs = spark.createDataFrame([("d1", "Plan | A", "two\nlines", 1.25), ("d2", None, None, None), ("d3", "Empty", "", 0.0)], "doc_id string, name string, summary string, elapsed double")
    rows = {r.doc_id: r for r in report.report_summary(opinions, results).collect()}
    one = rows["d1"]
    assert (one.critical_issues, one.n_high, one.n_medium, one.n_low, one.need_review, one.overall_verdict, one.total_score) == (["second"], 2, 1, 1, True, "fail", 16)
    assert one.recommendations == ["b", *[f"s{i:02d}" for i in range(9)]]
    assert (rows["d2"].critical_issues, rows["d2"].recommendations, rows["d2"].n_high, rows["d2"].n_medium, rows["d2"].n_low) == ([], [], 1, 1, 0)
    text = {r.doc_id: r.report for r in report.full_report(docs, results, opinions).collect()}
    first = text["d1"]
    marks = ["# Plan \\| A", "| about | two lines |", "| seconds | 1.3 |", "| high, medium, low | 2, 1, 1 |", "| review | yes |", "## Critical\n\n1. second", "## Part 1: Content", "### C1_structure: fail (4)", "- [medium] first\n- [high] second",
             "## Part 2: Depth and consistency", "### L2_plans: pass (12)", "- [low] weak\n- [high] fine", "## Part 5: Other", "### X9: pass (-)\n\n- nothing found", "## What to do\n\n1. b\n2. s00"]
    at = [first.index(m) for m in marks]
    assert at == sorted(at)
    assert "- [high] h\n- [medium] m\n- [medium] n" in text["d2"] and text["d2"].startswith("# d2\n")
    assert "| verdict | uncertain |" in text["d3"] and "## Part" not in text["d3"] and "| review | yes |" in text["d3"]
    assert report.full_report(docs.limit(0), results, opinions).count() == 0
