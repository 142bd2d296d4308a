import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import citations as cite
from tidemark.functions import model
from tidemark.operators import chunking, folds, store, structure
from tidemark.operators import sequence as seq
from tidemark.queries import QUERIES
from tidemark.sources import docx, parsed
from tidemark.streaming import trace

BLOCKS = "doc_id string, pos int, block_type string, text string, heading_level int, table_rows array<array<string>>"


def block_rows():
    table = [[f"r{i}", "x"] for i in range(11)]
    as_text = "\n".join("| " + " | ".join(r) + " |" for r in table)
    return [
        ("d", 0, "paragraph", "preface", None, None), ("d", 1, "heading", "1 岗位条件", 1, None), ("d", 2, "paragraph", "a" * 300, None, None),
        ("d", 3, "paragraph", "b" * 300, None, None), ("d", 4, "paragraph", "c", None, None), ("d", 5, "heading", "说明", 2, None),
        ("d", 6, "table", as_text, None, table), ("d", 7, "table", "| q |", None, [["q"]]), ("d", 8, "image", "", None, None),
        ("d", 9, "heading", "附录A 记录", 1, None), ("d", 10, "paragraph", "  ", None, None), ("e", 0, "heading", "没有编号的标题文字", 2, None),
    ]


def test_chunks(spark):
    got = chunking.chunk_blocks(spark.createDataFrame(block_rows(), BLOCKS)).collect()
    by = {r.chunk_id: r for r in got}
    assert by["d__ROOT__text__001"].content == "preface"
    # 300 + 1 + 300 characters are 841 tokens: the run closes with the second paragraph
    assert by["d__1__text__001"].content == "a" * 300 + "\n" + "b" * 300 and by["d__1__text__002"].content == "c"
    assert by["d__1.x__heading__001"].title == "说明"
    summary, full = by["d__1.x__table__001"], by["d__1.x__table__001__full"]
    assert summary.cross_refs == [full.chunk_id] and full.parent_id == summary.chunk_id
    assert summary.content.endswith("... 共 11 行") and summary.content.count("\n") == 4
    assert by["d__1.x__table__002"].cross_refs == [] and by["d__APP_A__heading__001"].section_path == "APP_A"
    assert "e__H2_没有编号的标题文__heading__001" in by
    assert len(got) == 11


def test_flush_groups(spark):
    df = spark.createDataFrame([([3.0, 3.0, 5.0, 1.0, 9.0, 2.0],)], "c array<double>")
    assert df.select(chunking.flush_groups(chunking.F.col("c"), 6).alias("g")).first().g == [0, 0, 1, 1, 2, 3]


def test_pseudo_headings(spark):
    cases = {"第一章 概况": 1, "1.1.1 目的": 3, "1.1 目的": 2, "一、概述": 1, "1. 总则": 1, "（一）岗位": 3, "附录 A": 1, "普通段落": None, "1.1 " + "长" * 60: None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.n for r in df.select("t", chunking.pseudo_heading_level(chunking.F.col("t")).alias("n")).collect()} == cases


def test_markdown_sections(spark):
    text = "intro\n# 第一章\n" + "x" * 70 + "\n## 目录\n" + "y" * 70 + "\n## 1.1 范围\n" + "z" * 2500 + "\n### short\nno"
    got = chunking.markdown_sections(spark.createDataFrame([("s", text)], "source string, text string"), ["source"], "text").collect()
    assert sorted((r.level, r.title, r.chapter, len(r.content)) for r in got) == [(1, "第一章", "第一章", 70), (2, "1.1 范围", "第一章", 2000)]


def test_citations(spark):
    text = "依据GB/T 21246-2020和TSG D7005—2018，另见Q/SY 1217。GB/T 21246-2020再次出现；GB 1.1"
    got = cite.citations(spark.createDataFrame([("d", text)], "doc_id string, text string"), ["doc_id"], "text")
    rows = {(r.norm, r.year): r for r in got.collect()}
    assert set(rows) == {("GBT21246", 2020), ("TSGD7005", 2018), ("QSY1217", None), ("GB1.1", None)}
    assert rows["QSY1217", None].context == text[max(0, text.index("Q/SY") - 40) : text.index("Q/SY") + 9 + 40]
    versions = spark.createDataFrame([("GBT21246", 2021, None), ("TSGD7005", 2018, "TSGD7006")], "norm string, latest_year int, superseded_by string")
    found = {(r.norm, r.kind, r.severity) for r in cite.version_findings(got, versions, ["doc_id"]).collect()}
    assert found == {("GBT21246", "outdated", "medium"), ("TSGD7005", "outdated", "high"), ("QSY1217", "untraceable", "low"), ("GB1.1", "untraceable", "low")}
    listed = spark.createDataFrame([("d", "GB1.1")], "doc_id string, norm string")
    assert {r.norm for r in cite.unlisted(got, listed, ["doc_id"]).collect()} == {"GBT21246", "TSGD7005", "QSY1217"}
    assert cite.unlisted(got, listed.limit(0), ["doc_id"]).count() == 0


def test_structure_rules(spark):
    chunks = [("good", "heading", f"{i} {t}", str(i), i) for i, t in enumerate(["岗位职责", "作业流程", "巡检", "操作规程", "应急", "培训"])]
    chunks += [("bad", "heading", "岗", "H1_岗", 0), ("empty", "text", "", "", 0)]
    df = spark.createDataFrame(chunks, "doc_id string, chunk_type string, title string, section_path string, pos int")
    got = {r.doc_id: (r.verdict, r.score, r.n_high, r.n_medium, r.n_low) for r in structure.structure_results(df).collect()}
    assert got == {"good": ("pass", 15, 0, 0, 0), "bad": ("fail", 5, 0, 7, 1), "empty": ("fail", 5, 1, 7, 0)}


def test_staffing(spark):
    text = "现有员工120人，安全工程师2名，管道里程共250公里的天然气管道，配置巡线工30人"
    facts = spark.createDataFrame([("d", text)], "doc_id string, t string").select("doc_id", *structure.staffing_facts(structure.F.col("t")))
    row = facts.first()
    assert (row.total_employees, row.safety_engineers_actual, row.patrol_workers_actual, row.pipeline_length_km) == (120, 2, 30, 250.0)
    facts = facts.withColumn("section_supervisors_actual", structure.F.lit(None).cast("int"))
    rules = {r.rule_id: r for r in structure.staffing_rules(facts).collect()}
    assert rules["E1_staffing.safety_engineer"].required == 3 and not rules["E1_staffing.safety_engineer"].passed
    assert structure.staffing_results(facts).first().verdict == "fail"
    none = facts.withColumn("pipeline_length_km", structure.F.lit(None).cast("double"))
    assert tuple(structure.staffing_results(none).first()) == ("d", "uncertain", 0, 30)


def test_model_answers(spark):
    raw = ['```json\n{"verdict": "pass", "score": 99, "confidence": -3}\n```', 'so: {"a": "}"} and {"b": 1}', "{broken", None, '{"verdict": "odd", "findings": [{"description": "d", "severity": "low"}, 3]}']
    assert [model.first_json_object(x) for x in raw[1:4]] == ['{"a": "}"}', None, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string").withColumn("j", model.json_object(model.F.col("raw")))
    got = {r.i: r for r in model.typed_results(df, "j").collect()}
    assert (got[0].verdict, got[0].score, got[0].confidence) == ("pass", 12, 0)
    assert (got[3].verdict, got[3].score, got[3].confidence, got[3].findings) == ("uncertain", 0, 70, [])
    assert got[4].verdict == "uncertain"

    def provider():
        return lambda text: json.dumps({"n": len(text)}) if text else 1 / 0

    answers = spark.createDataFrame([("ab",), ("",)], "p string").select(model.model_column(provider, model.F.col("p")).alias("a"))
    assert sorted(r.a for r in answers.collect()) == ["", '{"n": 2}']


def test_rater_merge_and_folds(spark):
    ddl = "dim string, verdict string, score int, confidence int"
    a = spark.createDataFrame([("x", "pass", 12, 91), ("y", "pass", 12, 90), ("z", "fail", 4, 80)], ddl)
    b = spark.createDataFrame([("x", "pass", 9, 80), ("y", "partial", 8, 95), ("w", "uncertain", 0, 30)], ddl)
    got = {r.dim: tuple(r)[1:] for r in folds.merge_raters(a, b, ["dim"]).collect()}
    assert got == {"x": ("pass", 10, 85, "agree", False), "y": ("partial", 8, 70, "diverge", True), "z": ("fail", 4, 80, "a_only", True), "w": ("uncertain", 0, 30, "b_only", True)}
    assert tuple(spark.createDataFrame([("pass", 12), ("partial", 8)], "verdict string, score int").agg(*folds.overall()).first()) == ("partial", 20)


def test_sequences(spark):
    spans = spark.createDataFrame([("k", 0, 5), ("k", 5, 8), ("k", 10, 12), ("k", 1, 2)], "k string, a int, b int")
    assert sorted(tuple(r) for r in seq.islands(spans, ["k"], "a", "b").collect()) == [("k", 0, 8, 3), ("k", 10, 12, 1)]
    rows = spark.createDataFrame([("k", i, 40) for i in range(4)], "k string, i int, n int")
    assert seq.within_budget(rows, ["k"], ["i"], seq.F.col("n"), 100).count() == 2
    assert seq.within_budget(rows, ["k"], ["i"], seq.F.col("n"), 10, first_always=True).count() == 1


def test_store(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, created int")
    new = spark.createDataFrame([(2, "c", 0), (3, "d", 0)], "k int, v string, created int")
    got = sorted(map(tuple, store.upsert_keeping(old, new, ["k"], "created", store.F.lit(99)).collect()))
    assert got == [(1, "a", 5), (2, "c", 6), (3, "d", 99)]


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr><w:tc>" + p("k") + "</w:tc><w:tc>" + p("v") + "</w:tc></w:tr></w:tbl>"
    xml = f"<w:document {w}><w:body>{p('Title', 'Heading1')}{p('1.1 目的')}{p('some text')}{table}</w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "my file.docx").write_bytes(data.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    got = sorted((r.doc_id, r.pos, r.block_type, r.heading_level) for r in docx.read_docx(spark, str(tmp_path)).collect())
    assert [g[1:] for g in got if g[0].startswith("my")] == [(0, "heading", 1), (1, "heading", 2), (2, "paragraph", None), (3, "table", None)]
    assert [g for g in got if g[0] == "broken"] == [("broken", 0, "error", None)]


def test_content_lists(spark):
    items = [("d", 0, "text", "T", 1, 0), ("d", 1, "header", "no", None, 0), ("d", 2, "text", "p" * 400, None, 0), ("d", 3, "text", "T", 1, 4)]
    blocks = parsed.content_list_blocks(spark.createDataFrame(items, "doc_id string, pos int, type string, text string, text_level int, page_idx int"))
    assert blocks.count() == 3 and len(parsed.summaries(blocks).first().summary) == 300
    assert [tuple(r) for r in parsed.table_of_contents(blocks).collect()] == [("d", 1, "T", 1)]


def stream(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).toPandas()


def test_streams(spark, tmp_path):
    ts = pd.Timestamp("2024-01-01")
    rows = [(i, (ts + pd.Timedelta(seconds=i)).to_pydatetime(), 1, "click", 1.0, "{}") for i in range(40)]
    spark.createDataFrame(rows, trace.EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = stream(spark, trace.rate_limited(trace.read_events(spark, str(tmp_path / "in")), limit=5, seconds=20), "limited", "append")
    assert sorted(got[got.accepted].event_id) == [0, 1, 2, 3, 4, 20, 21, 22, 23, 24]
    stats = stream(spark, trace.window_stats(trace.read_events(spark, str(tmp_path / "in"))), "stats", "complete")
    assert stats.n.sum() == 40


def test_ids_stay_different_beyond_their_least_length(spark, tmp_path):
    docs = spark.range(10_050).selectExpr("id AS doc_id", "'hot' AS source", "'t' AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = {r.doc_id: r.chunk_id for r in QUERIES["lag_lead_ids"](spark, str(tmp_path)).collect()}
    assert len(set(ids.values())) == 10_050
    assert (ids[7], ids[1000], ids[10_000]) == ("hot_0007", "hot_1000", "hot_10000")
    blocks = spark.range(1005).selectExpr("'d' AS doc_id", "int(id) AS pos", "'image' AS block_type", "'x' AS text", "int(null) AS heading_level", "cast(null AS array<array<string>>) AS table_rows")
    chunks = [r.chunk_id for r in chunking.chunk_blocks(blocks).collect()]
    assert len(set(chunks)) == 1005 and {"d__ROOT__image__007", "d__ROOT__image__1000"} <= set(chunks)


def test_every_line_item_has_its_rank(spark):
    keys = pd.read_parquet("/root/testdata/sf0.01/lineitem.parquet")[["l_orderkey", "l_linenumber"]].drop_duplicates()
    want = {f"{k}.{n}": i for i, (k, n) in enumerate(sorted(keys.itertuples(index=False, name=None)), 1)}
    assert {r.path: r["rank"] for r in QUERIES["natural_sort_rank"](spark, "/root/testdata/sf0.01").collect()} == want


def test_every_event_has_its_parent(spark):
    events = pd.read_parquet("/root/testdata/sf0.001/events.parquet").sort_values(["ts", "event_id"])
    want = []
    for user, values in events.groupby("user_id").value:
        levels = [1 + int(v // 1) % 4 for v in values]
        for pos, level in enumerate(levels, 1):
            want.append((user, pos, level, max((p for p, x in enumerate(levels[: pos - 1], 1) if x < level), default=None)))
    got = [tuple(r) for r in QUERIES["parent_heading"](spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == len(events) and sorted(got, key=str) == sorted(want, key=str)


def test_places_across_ranges(spark):
    """Ranks and neighbours within a key, over several ranges and with gaps."""
    from tidemark.operators.sequence import placed_within

    rows = [(s, i * i % 97 + 200 * (s == "a")) for s in ("a", "b", None) for i in range(40)]
    rows = sorted(set(rows), key=str)
    df = spark.createDataFrame(rows, "s string, i int")
    got = {(r.s, r.i): (r.rank, r.before, r.after) for r in placed_within(df, ["s"], F.col("i"), ["i"], F.col("i"), width=7).collect()}
    for s in ("a", "b", None):
        ordered = sorted(i for k, i in rows if k == s)
        for n, i in enumerate(ordered):
            assert got[s, i] == (n + 1, ordered[n - 1] if n else None, ordered[n + 1] if n + 1 < len(ordered) else None)
    assert len(got) == len(rows)


def test_rows_without_type_stay(spark):
    from tidemark.sources.parsed import content_list_blocks

    items = spark.createDataFrame([("d", 0, None, "text", None, 0), ("d", 1, "footer", "x", None, 0)], "doc_id string, pos int, type string, text string, text_level int, page_idx int")
    assert [r.text for r in content_list_blocks(items).collect()] == ["text"]


def test_scanned_pages(spark):
    from tidemark.sources.parsed import scanned

    pages = spark.createDataFrame([("a", 1, " x "), ("a", 2, ""), ("b", 1, "w" * 60), ("b", 2, "")], "doc_id string, page_num int, text string")
    assert {r.doc_id: r.is_scanned for r in scanned(pages).collect()} == {"a": True, "b": False}
