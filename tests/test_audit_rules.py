"""Rules on fixtures: appendices, images, contest output, leaders, emergencies, references, raters, sources, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import model
from tidemark.operators import consistency, contest, images, raters, references, retrieval, structure
from tidemark.sources import registry, sinks, store
from tidemark.streaming import trace

CHUNK = "doc_id string, pos int, chunk_type string, title string, content string, section_path string, heading_level int"


def chunk_rows():
    return [
        ("d1", 0, "toc", "目录", "1 总则 ...... 1\n2 岗位 .... 3\n3 没有 ... 5", "", None),
        ("d1", 1, "heading", "1 总则", "", "1", 1), ("d1", 2, "text", "", "详见附录A，参见附 件 C，见附录11", "1", None),
        ("d1", 3, "heading", "**2 岗位**", "", "2", 1),
        ("d1", 4, "heading", "附录A 表格", "", "APP_A", 1), ("d1", 5, "text", "附录A 表格", "这一段文字的长度要超过二十个字，这样才能算作有实质内容的附录，见附录Z", "APP_A", None),
        ("d1", 6, "heading", "附录B", "", "APP_B", 1), ("d1", 7, "text", "附录B", "太短", "APP_B", None),
        ("d1", 8, "heading", "附录D", "", "APP_D", 1), ("d1", 9, "table_full", "附录D", "| 一 | 二 | 三 | 四 | 五 | 六 | 七 |", "APP_D", None),
        ("d2", 0, "heading", "1 总则", "", "1", 1), ("d2", 1, "text", "", "请见附录A", "1", None),
        ("d3", 0, "heading", "9 附件", "9 附件", "9", 1), ("d3", 1, "text", "9 附件", "附件十一的内容足够长，超过二十个字，因此这个附件是有内容的", "9", None), ("d3", 2, "text", "", "详见附件11", "8", None),
    ]


def test_appendix_rules(spark):
    chunks = spark.createDataFrame(chunk_rows(), CHUNK)
    sections = {(r.doc_id, r.label): r.has_content for r in structure.appendix_sections(chunks).collect()}
    assert sections == {("d1", "A"): True, ("d1", "B"): False, ("d1", "D"): True, ("d3", ""): True}
    found = sorted((r.doc_id, r.rule_id, r.severity) for r in structure.appendix_findings(chunks).collect())
    assert found == [
        ("d1", "C1.appendix_content", "medium"), ("d1", "C1.appendix_continuity", "low"),
        ("d1", "C1.key_appendix", "medium"), ("d1", "C1.key_appendix", "medium"), ("d1", "C1.toc_mismatch", "medium"),
        ("d2", "C1.appendix_continuity", "low"), ("d2", "C1.key_appendix", "high"),
    ]
    assert structure.structure_results(chunks).count() == 3
    outline = {r.doc_id: r.outline for r in structure.toc_tree(chunks.where("chunk_type = 'heading'")).collect()}
    assert outline["d2"] == "1 总则"
    entries = spark.createDataFrame([("d1", i, f"t{i}", 10 + i) for i in range(8)], "doc_id string, pos int, title string, page int")
    pages = spark.createDataFrame([("d1", 10)], "doc_id string, n_pages int")
    assert sorted(r.severity for r in structure.toc_page_findings(entries, pages).collect()) == ["low", *["medium"] * 5]


def test_staffing_kinds_and_facts(spark):
    df = spark.createDataFrame([("天然气管道，管线总长 120 公里，巡线工 10 人",), ("原油管道",), ("成品油",)], "t string")
    kinds = [r.pipeline_kinds for r in df.select(*structure.staffing_facts(F.col("t"))).collect()]
    assert kinds == [["natural_gas"], [], ["oil"]]
    facts = spark.createDataFrame([(0.0, 3), (5.0, None), (5.0, 3)], "pipeline_length_km double, patrol_workers_actual int")
    assert [r[0] for r in facts.select(structure.enough_facts()).collect()] == [False, False, True]


def image(kind, **analysis):
    return ("d", f"c{kind}", kind, json.dumps(analysis, ensure_ascii=False))


@pytest.mark.parametrize(
    ("dimension", "rows", "want"),
    [
        ("I1_signature", [], ("uncertain", 0, 15)),
        ("I1_signature", [image("approval")], ("fail", 0, 80)),
        ("I1_signature", [image("approval", signatures=[{"role": r, "name_present": True, "date": d} for r, d in (("编制", "2024-01-02"), ("审核", "2024/1/3"), ("批准", "2024年1月4日"))])], ("pass", 12, 90)),
        ("I1_signature", [image("approval", signatures=[{"role": "编制", "name_present": True, "date": "2024.02.02"}, {"role": "审核", "name_present": True, "date": "2024-01-03"}])], ("fail", 5, 80)),
        ("I3_aerial", [image("hca_aerial", pipeline_visible=True, pipeline_solid_line=True, impact_radius_dashed=True, three_parallel_lines=True, buildings=[{"label": "a", "distance_marked": False}])], ("partial", 10, 80)),
        ("I3_aerial", [image("hca_aerial", pipeline_visible=True, three_parallel_lines=True)], ("partial", 8, 75)),
        ("I3_aerial", [image("hca_aerial")], ("fail", 4, 75)),
        ("I4_entry_route", [image("entry_route", route_marked=True, crosses_obstacles=["一条河流"])], ("fail", 5, 80)),
        ("I4_entry_route", [image("entry_route", route_marked=True)], ("pass", 12, 90)),
        ("I5_evacuation", [image("evacuation_route", evacuation_arrows_present=True), image("assembly_point", assembly_points_count=2)], ("pass", 12, 90)),
        ("I5_evacuation", [image("assembly_point")], ("fail", 2, 80)),
        ("I6_water_containment", [image("water_containment", containment_facility_marked=True)], ("partial", 9, 75)),
        ("I7_municipal_crossing", [image("municipal_crossing", crossing_marked=True, depth_marked=True)], ("pass", 12, 90)),
        ("I7_municipal_crossing", [], ("uncertain", 0, 80)),
    ],
)
def test_image_rules(spark, dimension, rows, want):
    df = spark.createDataFrame(rows, "doc_id string, chunk_id string, image_type string, analysis string")
    docs = spark.createDataFrame([("d", None)], "doc_id string, hca_type string")
    got = images.image_results(df, docs, dimension).first()
    assert (got.verdict, got.score, got.confidence) == want


def test_image_gates(spark):
    df = spark.createDataFrame([image("water_containment")], "doc_id string, chunk_id string, image_type string, analysis string")
    docs = spark.createDataFrame([("d", "population_intensive")], "doc_id string, hca_type string")
    assert images.image_results(df, docs, "I6_water_containment").first().confidence == 80
    assert images.image_results(df, docs, "I7_municipal_crossing").first().verdict == "fail"
    chunks = spark.createDataFrame([("d", i, "text", "周边环境", f"段落{i}", "1", None) for i in range(10)], CHUNK)
    aerial = spark.createDataFrame([image("hca_aerial")], "doc_id string, chunk_id string, image_type string, analysis string")
    gate = images.image_text_gate(docs, aerial, chunks).first()
    assert gate.ready and gate.text.count("---") == 7
    answers = spark.createDataFrame([("d", {"方向": "False", "图例": "uncertain: x", "ok": "true", "confidence": "0.9"}), ("e", {"a": "true"})], "doc_id string, answers map<string,string>")
    got = {r.doc_id: (r.verdict, r.score, r.confidence) for r in images.checklist_answers(answers).collect()}
    assert got == {"d": ("partial", 8, 90), "e": ("pass", 12, 70)}


def test_contest_rows(spark):
    kind = "doc_id string, dimension string, verdict string, score int, confidence int, need_human_review boolean, elapsed_seconds double, findings array<struct<severity:string,description:string,evidence:string,anchor_text:string,rule_id:string,problem_type:string,rule_basis:string,correction_suggestion:string>>"
    f = lambda s, d, r=None, p=None: (s, d, None, "anchor", r, p, None, None)
    rows = [
        ("x", "C3_language", "partial", 8, 75, False, 12.345, [f("high", "缺少章节"), f("low", "引用有误"), f("medium", "z", "C1.Title_length"), f("medium", "z", None, "own")]),
        ("x", "E9", "uncertain", None, 30, True, 1.0, []), ("y", "C3_language", "pass", 12, 95, False, 2.0, []),
    ]
    df = spark.createDataFrame(rows, kind)
    got = contest.contest_findings(df).orderBy("pos").collect()
    assert [r.problem_type for r in got] == ["缺少必要内容", "引用规范问题", "层级结构问题", "own"]
    assert {r.audit_dimension for r in got} == {"language"} and got[0].rule_basis.startswith("依据 GB/T 1.1") and got[0].evidence == "anchor"
    totals = {r.doc_id: r for r in contest.contest_summary(df).collect()}
    assert totals["x"].overall_verdict == "partial" and totals["x"].n_problems == 4 and totals["x"].need_review
    assert totals["y"].overall_verdict == "pass" and not totals["y"].has_problems
    shown = {r.doc_id: r for r in contest.dimension_summaries(df).collect()}
    assert shown["x"].elapsed == 12.35 or shown["x"].elapsed == 12.34
    assert [d.dimension for d in shown["x"].dimensions] == ["C3_language", "E9"]
    assert contest.opinions(df).where("doc_id = 'x' and dimension = 'C3_language'").first().opinion == "缺少章节; z; z; 引用有误"
    found = spark.createDataFrame([("x", 0, "2", "high", "b"), ("x", 1, "", "low", "c"), ("x", 2, "1", "low", "a")], "doc_id string, pos int, section_path string, severity string, description string")
    assert contest.findings_section(found).first().text == "- [low] 1: a\n- [high] 2: b\n- [low] c"


def test_leaders_and_codes(spark):
    text = "专职区段长姓名：李伟，区段长：王小明。专职区长 张三 负责。CPY-0123-AB 与 cpy-0456，K12+345 K12+345。基本信息 风险评价"
    df = spark.createDataFrame([("CPY_-0123_-AB", text), ("b", "区段长见下表"), ("c", " "), ("e", "无")], "doc_id string, text string")
    got = {r.doc_id: r for r in consistency.context_results(df).collect()}
    one = got["CPY_-0123_-AB"]
    assert {"李伟", "王小明", "张三"} <= set(one.leaders) and one.codes == ["CPY-0123-AB", "CPY-0456"] and one.stakes == ["K12+345"]
    assert (one.verdict, one.score) == ("partial", 7) and len(one.findings) == 3
    assert got["b"].findings[0].rule_id == "L1.leader_extract_uncertain" and got["c"].verdict == "uncertain" and got["e"].verdict == "pass"


def test_excerpts(spark):
    long = "a" * 500 + "KEY" + "b" * 300 + "KEY" + "c" * 2000 + "END" + "d" * 50
    df = spark.createDataFrame([(long,), ("short KEY",), ("z" * 3000,)], "t string")
    got = [r[0] for r in df.select(consistency.excerpt(F.col("t"), ["KEY", "END"], 100, 250, 900)).collect()]
    merged = [(400, 1053), (2706, 2859)]  # the first two of three overlap
    assert got[0] == "\n...\n".join(long[a:b] for a, b in merged) and got[1] == "short KEY" and got[2] == "z" * 900


def test_emergency(spark):
    rows = [("d", 0, "text", "", "发生泄漏立即上报", "3.1", None), ("d", 1, "text", "", "现场处置：关闭阀门", "附录C", None), ("e", 0, "text", "", "普通文字", "1", None), ("f", 0, "table_summary", "", "应急卡 事故", "2", None)]
    got = {r.doc_id: (r.relevant, r.missing_side) for r in consistency.emergency_sides(spark.createDataFrame(rows, CHUNK)).collect()}
    assert got == {"d": (True, "none"), "e": (False, "both"), "f": (True, "main")}
    df = spark.createDataFrame([("1. 立即上报\n2、关闭阀门\n步骤3：撤离", "1. 立即上报\n（2）关闭阀门")], "a string, b string")
    steps = df.select(consistency.numbered_steps(F.col("a")).alias("m"), consistency.numbered_steps(F.col("b")).alias("x"))
    got = consistency.compared_steps(steps, "m", "x").first()
    assert got.m == ["立即上报", "关闭阀门", "撤离"] and got.similarity == 0.8 and got.consistent and got.extra_in_main == ["撤离"] and got.missing_in_main == []


def test_references(spark):
    rows = [("d", 0, "text", "", "见附录a，如表 3-1 所示，图2，GB/T 1.1-2020 与 GB 50251—2015", "1", None), ("d", 1, "heading", "2 规范性引用文件", "GB 50251", "2", 1), ("d", 2, "text", "", "TSG D7003", "2", None), ("d", 3, "heading", "3 术语", "", "3", 1)]
    chunks = spark.createDataFrame(rows, CHUNK)
    got = {(r.kind, r.tag, r.year) for r in references.references(chunks).collect()}
    assert {("appendix", "A", None), ("table", "3-1", None), ("figure", "2", None), ("standard", "GBT11", 2020), ("standard", "GB50251", 2015)} <= got
    assert [r.pos for r in references.reference_section(chunks).orderBy("pos").collect()] == [1, 2]
    versions = spark.createDataFrame([("GB50251", 2015, None, "current"), ("GBT1.1", 2023, None, "current")], "norm string, latest_year int, superseded_by string, status string")
    found = references.version_check(chunks, versions)
    assert {(r.norm, r.kind) for r in found.collect()} >= {("GBT1.1", "outdated"), ("GBT1.1", "unlisted")}
    results = spark.createDataFrame([("d", "pass", 12, [])], "doc_id string, verdict string, score int, findings array<struct<severity:string,description:string,evidence:string,rule_id:string>>")
    assert len(references.with_version_findings(results, found).first().findings) == found.count()


def test_model_answers(spark):
    text = 'note {"a": 1} then ```json\n{"verdict": "PASS", "score": 99, "confidence": -3, "findings": [{"severity": "odd", "description": "' + "x" * 1200 + '"}, 7], "evidence_refs": ["r"]}\n```'
    assert json.loads(model.first_json_object(text))["verdict"] == "PASS"
    assert model.first_json_object('x {"s": "a } \\" {"} y') == '{"s": "a } \\" {"}' and model.first_json_object("{" * 5000) is None
    df = spark.createDataFrame([(model.first_json_object(text).replace(", 7", ""),), ("{}",), ("no",)], "answer string")
    got = model.explorer_answers(df, "answer").collect()
    assert got[0].verdict_hint == "pass" and got[0].score_hint == 12 and got[0].confidence == 0 and len(got[0].findings[0].description) == 1000 and got[0].findings[0].severity == "medium"
    assert got[1].verdict_hint == "uncertain" and got[1].confidence == 50
    critic = raters.critic_results(df.withColumn("dimension", F.lit("C2")), "answer").collect()
    assert critic[0].need_review and critic[2].verdict == "uncertain"
    facts = model.staffing_answers(spark.createDataFrame([('{"total_employees": 12, "pipeline_length_km": 3.5, "pipeline_names": ["a"]}',)], "answer string"), "answer").first()
    assert (facts.total_employees, facts.pipeline_length_km, facts.pipeline_names, facts.pipeline_count) == (12, 3.5, ["a"], 0)


def test_providers(spark):
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert model.with_retry(flaky)("p") == "ok" and len(calls) == 3
    with pytest.raises(PermissionError):
        model.with_retry(lambda p: (_ for _ in ()).throw(PermissionError()), fallback=lambda p: "no")("p")
    assert model.with_retry(lambda p: 1 / 0, retries=1, fallback=lambda p: "rule")("p") == "rule"
    make = model.provider({"kind": "scripted", "answers": {"city": '{"verdict": "fail", "confidence": 80}'}, "default": ""})
    work = spark.createDataFrame([("city",), ("town",)], "p string")
    got = raters.fan_out(work, model.model_column(make, F.col("p"))).orderBy("p").collect()
    assert [(r.verdict, r.need_review) for r in got] == [("fail", False), ("uncertain", True)]


def test_arbitration(spark):
    merged = spark.createDataFrame([("d", "C1", "fail", 1, 60, "A"), ("d", "C2", "pass", 9, 90, "merged")], "doc_id string, dimension string, verdict string, score long, confidence long, selected_from string")
    answers = spark.createDataFrame([("d", "C1", "pass", 50, 200), ("d", "C2", "fail", 0, 0), ("d", "C9", "pass", 1, 1)], "doc_id string, dimension string, verdict string, score int, confidence int")
    got = {r.dimension: (r.verdict, r.score, r.confidence, r.selected_from) for r in raters.arbitrated(merged, answers, ["doc_id"]).collect()}
    assert got == {"C1": ("pass", 12, 100, "arbitrated"), "C2": ("pass", 9, 90, "merged")}
    critic = spark.createDataFrame([("C1", 85, "n", None, "s"), ("C1", 70, "n", "p", "s"), ("C1", 90, "", "p", "s")], "dimension string, confidence int, skill_name string, skill_pattern string, skill_solution string")
    assert [r.name for r in raters.skills_of(critic).collect()] == ["n"]
    side = "struct<verdict_hint:string,score_hint:int,confidence_hint:int,summary:string,contradictions:array<struct<id:string,severity:string,description:string,quote_a:string,quote_b:string>>>"
    c = [(None, "high", "x", "p", "q")]
    rows = [(("pass", 9, 80, "s", c), ("PASS", 7, None, "s", c), None), (("pass", 9, 80, "s", c), ("pass", 7, None, "s", []), None)]
    kind = "verdict string, score long, confidence long, findings array<struct<severity:string,description:string,evidence:string,rule_id:string>>, details string"
    df = spark.createDataFrame(rows, f"a {side}, b {side}, critic struct<{kind.replace(' ', ':', 0).replace(' string', ':string').replace(' long', ':long').replace(' array', ':array')}>")
    got = raters.logic_results(df).collect()
    assert got[0].agree and got[0].result.score == 7 and got[0].result.confidence == 85 and got[0].result.findings[0].rule_id == "C5.c0" and not got[1].agree


def test_stores_and_sinks(spark, tmp_path):
    seed = spark.createDataFrame([("a", "S", "1", "t", "c", ["C2"])], store.CLAUSE)
    assert store.seeded(store.seeded(seed.limit(0), seed), seed).count() == 1 and store.tagged(seed, "C2").count() == 1
    entries = [{"number": "GB/T 1.1-2020", "latest_year": 2020}, {"title": "none"}, "bad"]
    assert [r.norm for r in store.versions_from(spark, entries).collect()] == ["GBT1.1"]
    rules = spark.createDataFrame([("default", 1), ("mine", 2)], "rule_id string, body int")
    left = store.rule_changes(rules, spark.createDataFrame([("mine", 3)], "rule_id string, body int"), spark.createDataFrame([("default",), ("mine",)], "rule_id string"))
    assert [tuple(r) for r in left.collect()] == [("default", 1)]
    assert store.rules_or_default(rules.limit(0), rules.where("rule_id = 'default'")).count() == 1 and store.rules_or_default(rules, rules.where("rule_id = 'default'")).count() == 2
    (tmp_path / "c.json").write_text('{"path": "./x", "n": [1, "./y"]}')
    assert store.config(str(tmp_path / "c.json")) == {"path": str(tmp_path / "x"), "n": [1, str(tmp_path / "y")]}
    (tmp_path / "t1").mkdir()
    (tmp_path / "t1" / "b_audit.json").write_text('{"v": 2}')
    (tmp_path / "t1" / "a_audit.json").write_text('{"v": 1}')
    assert [(r.task, r.result) for r in store.result_files(spark, str(tmp_path)).collect()] == [("t1", '{"v": 1}')]
    sections = spark.createDataFrame([("GB 1", i, f"t{i}", "text") for i in range(3)] + [("old", 0, "t", "x")], "source string, pos int, title string, content string")
    got = store.import_sections(sections, spark.createDataFrame([("old",)], "source string"), embed=retrieval.hashed_vector).orderBy("pos").collect()
    assert [(r.chunk_id, r.prev_id, r.next_id) for r in got][1] == ("GB_1_0001", "GB_1_0000", "GB_1_0002") and sum(x * x for x in got[0].vector) == pytest.approx(1)
    reports = spark.createDataFrame([("d", "# head\n\ntext"), ("e", "x")], "doc_id string, report string")
    sinks.write_outputs(reports, reports, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "json")).count() == 2 and (tmp_path / "out" / "markdown" / "doc_id=d").is_dir()
    blocks = spark.createDataFrame([("d", 0, "intro words"), ("d", 1, "3.2 valves close"), ("d", 2, "the pressure is too high")], "doc_id string, pos int, text string")
    findings = spark.createDataFrame([("d", "pressure is to high", "", 0), ("d", "x", "3.2", 0), ("d", "", "", 9)], "doc_id string, anchor_text string, section_path string, paragraph_index int")
    assert sorted(r.paragraph for r in sinks.placed_comments(findings, blocks).collect()) == [1, 2, 2]
    with pytest.raises(ValueError, match="no reader"):
        registry.read_blocks(spark, "x", ".xyz")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "my file.docx").write_bytes(b"1")
    row = registry.files_with_cache(spark, str(tmp_path / "f"), spark.createDataFrame([("none",)], "file_hash string")).first()
    assert (row.suffix, row.doc_id, row.supported, row.cached) == (".docx", "my_file", True, False)


def test_contexts(spark):
    chunks = spark.createDataFrame([("d", i, "t", "x" * 100, ["A"] if i == 3 else []) for i in range(5)], "doc_id string, pos int, title string, content string, dimensions array<string>")
    dims = spark.createDataFrame([("A",), ("B",)], "dimension string")
    got = {(r.dimension, r.pos) for r in retrieval.context_rows(chunks, dims, 250).collect()}
    assert got == {("A", 3), ("B", 0), ("B", 1)}
    skills = spark.createDataFrame([("s1", "泄漏处置", "p", "关闭阀门", 3, "E2"), ("s2", "标点", "p", "检查", 9, "C3")], "skill_id string, name string, pattern string, solution string, used_count int, dimension string")
    queries = spark.createDataFrame([(1, "发生 泄漏 怎么办"), (2, "无关")], "q int, text string")
    assert [(r.q, r.skill_id) for r in retrieval.skill_search(queries, skills, "q", "text").collect()] == [(1, "s1")]
    rows = spark.createDataFrame([("q", 1, "GB 1", "5.2", "职责", "内容"), ("q", 2, "GB 2", "", None, "其他")], "q string, rank int, standard_name string, clause_num string, title string, content string")
    assert retrieval.snippet_text(rows, ["q"]).first().text == "[GB 1 5.2] 职责: 内容\n[GB 2] 其他"
    found = spark.createDataFrame([("d", "f1", "c9", "bbb"), ("d", "f2", "c0", "zz")], "doc_id string, finding_id string, chunk_id string, evidence string")
    texts = spark.createDataFrame([("d", "c0", 0, "aaa"), ("d", "c1", 1, "xbbbx")], "doc_id string, chunk_id string, pos int, content string")
    assert {(r.finding_id, r.chunk_id, r.pos) for r in retrieval.matched_chunks(found, texts).collect()} == {("f1", "c1", 1), ("f2", "c0", 0)}


def test_monitor_and_sessions(spark, tmp_path):
    spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02}", 1, "click", 1.0, "{}") for i in range(20)], "event_id long, t string, user_id long, event_type string, value double, props string").selectExpr(
        "event_id", "to_timestamp(t) ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "in"))
    seen = []
    q = trace.monitor(trace.read_events(spark, str(tmp_path / "in")), str(tmp_path / "ring"), str(tmp_path / "ck"), lambda b: seen.append(b.count()), keep=5)
    q.awaitTermination(120)
    assert sum(seen) == 20 and sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "ring")).collect()) == [15, 16, 17, 18, 19]
    rows = spark.createDataFrame([(1, "pending"), (1, "auditing"), (1, "dimension"), (2, "failed"), (3, "ingesting")], "user_id long, stage string")
    rows.write.parquet(str(tmp_path / "s"))
    out = trace.session_states(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert {(r.user_id, r.state, r.n_done) for r in spark.table("states").collect()} == {(1, "auditing", 1), (2, "failed", 0), (3, "ingesting", 0)}
    sinks.append_events(trace.read_events(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "ck2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 20
