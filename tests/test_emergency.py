"""The emergency dimension from rows to verdicts with a scripted model."""

from tidemark.operators import emergency

STEPS = '{"main_steps":["立即上报","关闭阀门"," "],"appendix_steps":["立即上报","关闭阀门"],"missing_side":"%s","summary":"一致"}'
REVIEW = '{"verdict":"pass","score":12,"confidence":88,"details":"ok","findings":[{"severity":"low","description":"x","evidence":"y","rule_id":"z"}]}'


def model(asked_of):
    """Answers by what the prompt asks and the document it is about; raises for one, says nothing useful for another."""

    def make():
        def ask(prompt):
            name = next((k for k in ("docA", "docB", "docC", "docD", "docE") if k in prompt), "")
            steps = prompt.startswith("steps")
            if name == "docB" and steps or name == "docC" and not steps:
                raise TimeoutError
            if name == "docD" and not steps:
                return "no object here"
            if not steps and "clause text" not in prompt:
                return "{}"
            return f"thinking {{ {STEPS % ('nonsense' if name == 'docA' else 'Appendix')}" if steps else REVIEW

        return ask

    return make


def test_rows_to_verdicts(spark):
    rows = []
    for name in ("docA", "docB", "docC", "docD"):
        rows += [(name, 0, "text", "3.1", f"{name} 应急处置流程：发现泄漏后立即上报，关闭阀门。"), (name, 1, "TEXT", "附录C", "附录C 现场处置卡：应急 立即上报，关闭阀门。")]
    rows += [("docE", 0, "text", "1", "docE 员工培训记录"), ("docF", 0, "image", "1", "应急")]
    chunks = spark.createDataFrame(rows, "doc_id string, pos int, chunk_type string, section_path string, content string")
    snippets = spark.createDataFrame([(d, "clause text") for d in ("docA", "docB", "docC", "docD")], "doc_id string, text string")
    got = {r.doc_id: r for r in emergency.emergency_results(chunks, model(None), snippets).collect()}
    a = got["docA"]
    assert (a.verdict, a.score, a.confidence, a.need_review, a.main_steps, a.appendix_steps, a.missing_side, a.summary, a.similarity) == ("pass", 12, 88, False, ["立即上报", "关闭阀门"], ["立即上报", "关闭阀门"], "none", "一致", 1.0)
    assert [f.rule_id for f in a.findings] == ["z"]
    b = got["docB"]  # the steps could not be read, the review goes on
    assert (b.verdict, b.main_steps, b.summary) == ("pass", [], "")
    assert (got["docC"].verdict, got["docC"].confidence, got["docC"].missing_side) == ("uncertain", 20, "appendix")
    assert (got["docD"].verdict, got["docD"].confidence, got["docD"].need_review) == ("uncertain", 25, True)
    for quiet in ("docE", "docF"):
        assert (got[quiet].verdict, got[quiet].score, got[quiet].confidence, got[quiet].need_review, got[quiet].similarity) == ("uncertain", 0, 20, True, None)
    assert emergency.emergency_results(chunks.limit(0), model(None)).count() == 0
