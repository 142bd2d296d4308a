import datetime

from tidemark.operators import evaluators as e

F = e.F


def test_coverage(spark):
    df = spark.createDataFrame([("a", "编制 审核"), ("b", "")], "doc_id string, t string")
    got = {r.doc_id: r for r in e.coverage(df, "doc_id", F.col("t"), {"编制": ["编制"], "审核": ["审核", "校对"], "批准": ["批准"]}).collect()}
    assert got["a"].covered == 2 and got["a"].missing == ["批准"] and got["b"].covered == 0
    ladder = e.share_ladder(F.col("r"), [(0.85, "pass", 12), (0.6, "partial", 8)], ("fail", 4))
    rows = spark.createDataFrame([(0.9,), (0.6,), (0.1,)], "r double").select(*ladder).collect()
    assert [tuple(r) for r in rows] == [("pass", 12), ("partial", 8), ("fail", 4)]


def test_dates(spark):
    texts = ["识别日期：2023年5月6日，评价日期 2023-04-01，编制 2024.1.2", "没有日期", "识别日期：2023-13-45"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string")
    dates = df.select("doc_id", *[e.date_near(F.col("t"), k).alias(n) for k, n in (("识别", "i"), ("评价", "v"), ("编制", "c"))])
    first = dates.where("doc_id = 0").first()
    assert (first.i, first.v, first.c) == (datetime.date(2023, 5, 6), datetime.date(2023, 4, 1), datetime.date(2024, 1, 2))
    got = {r.doc_id: (r.n_dates, r.inverted, r.many_years, r.verdict) for r in e.time_order(dates, "doc_id", ["i", "v", "c"]).collect()}
    assert got == {0: (3, True, True, "fail"), 1: (0, False, False, "uncertain"), 2: (0, False, False, "uncertain")}


def test_potentials(spark):
    df = spark.createDataFrame([("电位为-0.95V，最低 −1.35 V",)], "t string")
    row = df.select(e.potentials(F.col("t")).alias("p")).select("p", e.outside_range(F.col("p"), -1.2, -0.85).alias("o")).first()
    assert row.p == [-0.95, -1.35] and row.o == [-1.35]


def test_requirements_and_checklists(spark):
    need = spark.createDataFrame([("d", "I1"), ("d", "I2"), ("d", "I3"), ("d", "I4")], "doc_id string, kind string")
    here = spark.createDataFrame([("d", "I1"), ("d", "I1"), ("d", "I4")], "doc_id string, kind string")
    row = e.missing_kinds(here, need, "doc_id", "kind").first()
    assert row.missing == ["I2", "I3"] and row.verdict == "partial"
    answers = spark.createDataFrame([("d", {"方向": "缺失", "比例尺": "false", "图例": "true"})], "doc_id string, a map<string,string>")
    got = sorted((r.item, r.severity) for r in e.checklist_issues(answers, ["doc_id"], "a", ["缺失", "否"], ["方向"]).collect())
    assert got == [("方向", "high"), ("比例尺", "medium")]
    rows = spark.createDataFrame([(0, 90), (2, 84), (5, 50)], "n_issues int, confidence int")
    assert [(r.verdict, r.score) for r in e.checklist_verdict(rows).collect()] == [("pass", 12), ("partial", 8), ("fail", 0)]


def test_evidence(spark):
    claims = spark.createDataFrame([("a", "d", "this is in the text", 0), ("a", "d", "this one is nowhere", 1), ("a", "d", "short", 2), ("b", "d", "x", 0)], "rater string, doc_id string, ev string, pos int")
    texts = spark.createDataFrame([("d", "well, this is in the text indeed")], "doc_id string, t string")
    got = {r.rater: (r.n_claims, r.n_found, r.verified) for r in e.evidence_vote(claims, texts, ["rater"], "doc_id", "ev", "t").collect()}
    assert got == {"a": (2, 1, True), "b": (0, 0, True)}


def test_report(spark):
    results = spark.createDataFrame([("d", "C1", "pass", 15), ("d", "C3", "partial", 8)], "doc_id string, dimension string, verdict string, score int")
    findings = spark.createDataFrame([("d", "C3", "medium", "typo")], "doc_id string, dimension string, severity string, description string")
    row = e.audit_report(results, findings).first()
    assert (row.overall_verdict, row.total_score, row.normalised) == ("partial", 23, 17)
    assert row.report == "# d\n\nverdict: partial\n\n## C1: pass (15)\n\n## C3: partial (8)\n- [medium] typo"
