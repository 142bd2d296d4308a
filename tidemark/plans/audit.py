"""Queries of the audit: appendix rules, contest output, raters with findings, reviews, references, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.lexicons import DOCUMENT_TYPES, RULE_BASIS
from tidemark.operators import chunking, consistency, contest, evaluators, images, raters, references, structure
from tidemark.operators.sequence import top
from tidemark.plans.documents import _FINDINGS_SQL, SEVERITY_WORDS, _structure_results, keyword_findings
from tidemark.queries import query
from tidemark.session import table
from tidemark.sources import registry


def _long(c: Column) -> Column:
    return c.cast("long")


# Conversations as chunk rows: user turns are appendix headings, assistant turns refer to appendices.
_CHUNKS_SQL = """ch AS (SELECT conv_id AS doc_id, turn AS pos, role = 'user' AS opens, CASE WHEN role = 'user' THEN chr((65 + turn % 26)::INT) END AS label,
CASE WHEN role = 'assistant' THEN chr((65 + turn % 5)::INT) END AS ref, length(trim(CASE WHEN role = 'assistant' THEN '详见附录A ' ELSE '' END || text)) > 20 AS filled FROM conversations)"""


def _conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    letter = lambda n: F.chr(65 + F.col("turn") % n)
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return rows.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(user, "heading").otherwise("text").alias("chunk_type"), F.lit("").alias("section_path"),
        F.when(user, F.concat(F.lit("**附录"), letter(26), F.lit("**"))).alias("title"),
        F.when(assistant, F.concat(F.lit("详见附录"), letter(5), F.lit(" "), "text")).otherwise(F.col("text")).alias("content"))


@query(f"""WITH {_CHUNKS_SQL}, p AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM ch)
SELECT doc_id, part::BIGINT AS part, max(label) AS label, coalesce(bool_or(filled AND NOT opens), false) AS has_content FROM p WHERE part > 0 GROUP BY doc_id, part""")
def appendix_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether something of substance follows each appendix heading before the next one."""
    found = structure.appendix_sections(_conversation_chunks(spark, sf_dir))
    return top(found, ["doc_id"], ["pos"], 1 << 30, "part").select("doc_id", "part", "label", "has_content")


@query(f"""WITH {_CHUNKS_SQL}, sec AS (SELECT doc_id, label FROM ch WHERE opens), refs AS (SELECT doc_id, ref FROM ch WHERE ref IS NOT NULL),
have AS (SELECT doc_id, list_sort(list(label)) AS letters FROM sec GROUP BY doc_id),
lost AS (SELECT DISTINCT doc_id, 'C1.key_appendix' AS rule_id, 'high' AS severity FROM refs WHERE doc_id NOT IN (SELECT doc_id FROM have)),
absent AS (SELECT DISTINCT r.doc_id, 'C1.key_appendix' AS rule_id, 'medium' AS severity, r.ref FROM refs r JOIN have h USING (doc_id) WHERE NOT list_contains(h.letters, r.ref)),
none AS (SELECT DISTINCT doc_id, 'C1.appendix_continuity' AS rule_id, 'low' AS severity FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM have)),
jumps AS (SELECT doc_id, 'C1.appendix_continuity' AS rule_id, 'low' AS severity FROM have WHERE len(letters) >= 2
          AND letters <> list_transform(range(len(letters)), lambda i: chr((ascii(letters[1]) + i)::INT)))
SELECT doc_id, rule_id, severity, count(*) AS n FROM (SELECT * FROM lost UNION ALL SELECT doc_id, rule_id, severity FROM absent UNION ALL SELECT * FROM none UNION ALL SELECT * FROM jumps) GROUP BY ALL""")
def appendix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to appendices that are not there, and labels out of sequence, counted by rule."""
    found = structure.appendix_findings(_conversation_chunks(spark, sf_dir)).where("rule_id <> 'C1.appendix_content'")
    return found.groupBy("doc_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id AS doc_id, md5(string_agg(repeat('  ', greatest(len(string_split(path, '.')) - 1, 0)::INT) || role, chr(10) ORDER BY turn)) AS outline
FROM (SELECT *, CASE turn % 3 WHEN 0 THEN '1' WHEN 1 THEN '1.2' ELSE '1.2.3' END AS path FROM conversations) GROUP BY conv_id""")
def heading_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings in order, indented by the dots of their path."""
    path = F.when(F.col("turn") % 3 == 0, "1").when(F.col("turn") % 3 == 1, "1.2").otherwise("1.2.3")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("role").alias("title"), F.lit(None).cast("int").alias("heading_level"), path.alias("section_path"))
    return structure.toc_tree(rows).select("doc_id", F.md5("outline").alias("outline"))


@query("SELECT l_orderkey, l_linenumber, (1 + length(p) - length(replace(p, '.', '')))::BIGINT AS level, trim(replace('** ' || p || ' **', '*', '')) AS title FROM (SELECT *, l_orderkey || '.' || l_linenumber AS p FROM lineitem)")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels by the dots of a path, and titles without emphasis."""
    path = F.concat_ws(".", "l_orderkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", path.alias("p"))
    return rows.select("l_orderkey", "l_linenumber", _long(structure.heading_level(F.col("p"))).alias("level"), tx.strip_emphasis(F.concat(F.lit("** "), "p", F.lit(" **"))).alias("title"))


# Findings of documents as the contest wants them: the rule id goes by severity, low ones have none.
_RULES = {"high": "E1_staffing.patrol", "medium": "C1.appendix", "low": ""}


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dimension, verdict, score, confidence, findings, need_human_review) by keywords."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = keyword_findings(docs, SEVERITY_WORDS).where("severity is not null")
    text = lambda c: c.cast("string")
    rule = tx.first_match(F.col("severity"), [(F.col("severity") == s, F.lit(r)) for s, r in _RULES.items()])
    none = text(F.lit(None))
    finding = F.struct("severity", F.col("keyword").alias("description"), F.col("keyword").alias("evidence"), rule.alias("rule_id"), none.alias("anchor_text"), none.alias("problem_type"), none.alias("rule_basis"), none.alias("correction_suggestion"))
    lists = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    rows = _structure_results(spark, sf_dir).join(lists, "doc_id", "left")
    empty = F.array().cast(lists.schema["findings"].dataType)
    return rows.select("doc_id", "source", F.lit("C1_structure").alias("dimension"), "verdict", "score", "confidence", F.coalesce("findings", empty).alias("findings"), (F.col("verdict") == "fail").alias("need_human_review"))


@query(f"""WITH {_FINDINGS_SQL} SELECT f.doc_id, f.keyword AS evidence, 'structure' AS audit_dimension, 'C1_structure' AS audit_subtype, v.verdict <> 'pass' AS is_problem, f.severity,
CASE f.severity WHEN 'high' THEN '人员配置问题' WHEN 'medium' THEN '附录问题' ELSE '内容问题' END AS problem_type, '{RULE_BASIS['C1_structure']}' AS rule_basis
FROM f JOIN v USING (doc_id) WHERE f.severity IS NOT NULL""")
def contest_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the contest's dimension, type of problem and basis."""
    return contest.contest_findings(_results(spark, sf_dir)).select("doc_id", "evidence", "audit_dimension", "audit_subtype", "is_problem", "severity", "problem_type", "rule_basis")


@query(f"""WITH {_FINDINGS_SQL} SELECT doc_id, verdict AS overall_verdict, h AS n_high, m AS n_medium, l AS n_low, h + m + l AS n_problems, h + m + l > 0 AS has_problems, verdict = 'fail' AS need_review FROM v""")
def contest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contest's counts and its own fold of verdicts for each document."""
    return contest.contest_summary(_results(spark, sf_dir))


@query(f"""WITH {_FINDINGS_SQL} SELECT source, CASE WHEN bool_or(verdict = 'fail') THEN 'fail' WHEN bool_or(verdict = 'partial') THEN 'partial' WHEN bool_and(verdict = 'pass') THEN 'pass' ELSE 'uncertain' END AS overall_verdict FROM v GROUP BY source""")
def strict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other roll-up of verdicts, in which partial comes before pass."""
    return _structure_results(spark, sf_dir).groupBy("source").agg(contest.strict_overall())


@query(f"""WITH {_FINDINGS_SQL}, o AS (SELECT source AS doc_id, count(*) FILTER (verdict = 'fail') AS n_fail, count(*) FILTER (verdict = 'partial') AS n_partial, count(*) AS n FROM v GROUP BY source)
SELECT *, CASE WHEN n_fail > 0 THEN '文档存在 ' || n_fail || ' 项严重问题，需要重点整改后方可使用。' WHEN n_partial > 0 THEN '文档存在 ' || n_partial || ' 项待改进之处，建议按建议优化后可投入使用。'
ELSE '文档基本符合要求，仅有个别细节需注意。' END AS opinion FROM o""")
def overall_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence for each source from its verdicts."""
    return contest.overall_opinion(_structure_results(spark, sf_dir).select(F.col("source").alias("doc_id"), "verdict"))


@query(f"WITH {_FINDINGS_SQL} SELECT d.lang AS module, count(*) AS n, sum(v.score)::BIGINT AS score, count(*) FILTER (v.verdict <> 'pass') AS n_problem FROM v JOIN documents d USING (doc_id) GROUP BY d.lang")
def module_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and problems by module (the language stands for it)."""
    rows = _structure_results(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return contest.by_module(rows, F.col("lang"))


@query(f"WITH {_FINDINGS_SQL} SELECT doc_id, severity, keyword FROM f WHERE severity = 'high'")
def located_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of one severity, as a viewer asks for them."""
    rows = keyword_findings(table(spark, sf_dir, "documents").select("doc_id", "text"), SEVERITY_WORDS)
    return contest.located_findings(rows, severity="high").select("doc_id", "severity", "keyword")


@query("SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY path = '', path, p_partkey) AS place FROM (SELECT *, CASE WHEN p_size > 40 THEN '' ELSE p_brand END AS path FROM part)")
def findings_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of findings in a report: by section, those without one last."""
    rows = table(spark, sf_dir, "part").withColumn("section_path", F.when(F.col("p_size") > 40, "").otherwise(F.col("p_brand")))
    return top(rows, ["p_type"], [*contest.by_section(rows), "p_partkey"], 1 << 30, "place").select("p_partkey", "p_type", "place")


# Two raters with findings: one goes by words of the text, one by the labels.
_RATERS_SQL = f"""{_FINDINGS_SQL},
a AS (SELECT v.doc_id, v.verdict, v.score, v.confidence, coalesce((SELECT list(keyword) FROM f WHERE f.doc_id = v.doc_id AND keyword IS NOT NULL), []) AS fs FROM v),
b AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'fail' WHEN quality = 0 THEN 'partial' ELSE 'pass' END AS verdict, CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 9 ELSE 15 END AS score,
      CASE WHEN quality = 0 THEN 60 ELSE 90 END AS confidence, list_concat(CASE WHEN toxic = 1 THEN ['disgusting', 'toxic'] ELSE [] END, CASE WHEN quality = 0 THEN ['License'] ELSE [] END) AS fs FROM labels),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.verdict AS va, b.verdict AS vb, a.score AS sa, b.score AS sb, a.confidence AS ca, b.confidence AS cb, a.fs AS fa, b.fs AS fb,
      CASE a.verdict WHEN 'fail' THEN 3 WHEN 'partial' THEN 2 ELSE 0 END >= CASE b.verdict WHEN 'fail' THEN 3 WHEN 'partial' THEN 2 ELSE 0 END AS a_first FROM a FULL JOIN b ON a.doc_id = b.doc_id)"""


def _finding(severity: str, name: str) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("description"), none.alias("evidence"), none.alias("rule_id"))


def _raters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    words = [(s, w) for s, ws in SEVERITY_WORDS.items() for w in ws]
    hits = F.array_compact(F.array(*[F.when(F.col("text").contains(w), _finding(s, w)) for s, w in words]))
    a = _structure_results(spark, sf_dir).join(docs.select("doc_id", hits.alias("findings")), "doc_id").select("doc_id", "verdict", "score", "confidence", "findings", F.lit(False).alias("need_review"))
    toxic, poor = F.col("toxic") == 1, F.col("quality") == 0
    found = F.array_compact(F.array(F.when(toxic, _finding("high", "disgusting")), F.when(toxic, _finding("high", "toxic")), F.when(poor, _finding("medium", "License"))))
    b = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(toxic, "fail").when(poor, "partial").otherwise("pass").alias("verdict"), _long(F.when(toxic, 3).when(poor, 9).otherwise(15)).alias("score"),
        _long(F.when(poor, 60).otherwise(90)).alias("confidence"), found.alias("findings"), F.lit(False).alias("need_review"))
    return a, b


@query(f"""WITH {_RATERS_SQL} SELECT doc_id,
CASE WHEN vb IS NULL THEN va WHEN va IS NULL THEN vb WHEN va = vb THEN va WHEN a_first THEN va ELSE vb END AS verdict,
(CASE WHEN vb IS NULL THEN sa WHEN va IS NULL THEN sb WHEN va = vb THEN (sa + sb) // 2 WHEN a_first THEN sa ELSE sb END)::BIGINT AS score,
(CASE WHEN vb IS NULL THEN ca WHEN va IS NULL THEN cb WHEN va = vb THEN (ca + cb) // 2 ELSE least(70, CASE WHEN a_first THEN ca ELSE cb END) END)::BIGINT AS confidence,
(CASE WHEN vb IS NULL THEN len(fa) WHEN va IS NULL THEN len(fb) WHEN va = vb THEN len(list_distinct(list_concat(fa, fb))) WHEN a_first THEN len(fa) ELSE len(fb) END)::BIGINT AS n_findings,
CASE WHEN va IS NULL OR vb IS NULL THEN true WHEN va = vb THEN (ca + cb) // 2 < 50 ELSE true END AS need_review,
CASE WHEN vb IS NULL THEN 'a_only' WHEN va IS NULL THEN 'b_only' WHEN va = vb THEN 'merged' WHEN a_first THEN 'A' ELSE 'B' END AS selected_from FROM j""")
def rater_findings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters merged with their findings: a union where they agree, the stricter one's where not."""
    merged = raters.merge_results(*_raters(spark, sf_dir), ["doc_id"])
    return merged.select("doc_id", "verdict", "score", "confidence", _long(F.size("findings")).alias("n_findings"), "need_review", "selected_from")


@query(f"""WITH {_RATERS_SQL}, k AS (SELECT *, cb >= 90 AS bv FROM j WHERE va IS NOT NULL AND vb IS NOT NULL)
SELECT doc_id, CASE WHEN bv THEN vb ELSE va END AS verdict, (CASE WHEN bv THEN sb ELSE sa END)::BIGINT AS score, least(70, CASE WHEN bv THEN cb ELSE ca END)::BIGINT AS confidence,
(CASE WHEN bv THEN len(fb) + len(list_filter(fa, lambda x: x IN ('password', 'disgusting') AND NOT list_contains(fb, x))) ELSE len(fa) END)::BIGINT AS n_findings, CASE WHEN bv THEN 'B' ELSE 'merged' END AS selected_from FROM k""")
def critic_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge in place of a critic: the second rater where it is verified, with the first one's high findings."""
    a, b = _raters(spark, sf_dir)
    answer = lambda df, name: df.select("doc_id", F.struct(F.col("verdict").alias("verdict_hint"), F.col("score").alias("score_hint"), "confidence", "findings").alias(name))
    rows = answer(a, "a").join(answer(b, "b"), "doc_id").withColumns({"a_verified": F.lit(True), "b_verified": F.col("b.confidence") >= 90})
    merged = raters.fallback_merge(rows)
    return merged.select("doc_id", "verdict", "score", "confidence", _long(F.size("findings")).alias("n_findings"), "selected_from")


@query(f"""WITH {_FINDINGS_SQL} SELECT v.doc_id, coalesce(v.verdict = 'uncertain', false) OR coalesce(b.toxic = 1, false) OR v.confidence < 50 OR v.h >= 3
OR coalesce(b.quality = 0 AND v.m <= 0, false) AS need_review, v.h AS n_high FROM v LEFT JOIN labels b USING (doc_id)""")
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a person must look: not verified, unsure, many high findings, or few rules passed."""
    rows = _structure_results(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    dimension = F.when(F.col("quality") == 0, "E1_staffing").otherwise("C1_structure")
    passed = F.when(F.col("n_medium") <= 0, 2).otherwise(3)
    review = raters.needs_review(dimension, F.col("verdict"), F.col("confidence"), F.col("n_high"), ~(F.col("toxic") == 1), F.lit("A"), passed, F.lit(1.0), F.lit(False))
    return rows.select("doc_id", review.alias("need_review"), "n_high")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber > 3 AS second, list_sort(list('{"f":"' || l_returnflag || '","s":"' || l_linestatus || '"}')) AS c, max(l_returnflag) AS h FROM lineitem GROUP BY ALL)
SELECT a.l_orderkey, a.c = b.c AND a.h = b.h AS agree FROM (SELECT * FROM s WHERE NOT second) a JOIN (SELECT * FROM s WHERE second) b USING (l_orderkey)""")
def explorer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two explorers found the same, whatever the order (the first and the later lines of an order)."""
    rows = table(spark, sf_dir, "lineitem").withColumn("second", F.col("l_linenumber") > 3)
    hint = F.when(F.max("l_returnflag") == "A", "pass").when(F.max("l_returnflag") == "N", "partial").otherwise("fail")
    found = rows.groupBy("l_orderkey", "second").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"))).alias("contradictions"), hint.alias("verdict_hint"))
    side = lambda second, name: found.where(F.col("second") == second).select("l_orderkey", F.struct("contradictions", "verdict_hint").alias(name))
    return side(False, "a").join(side(True, "b"), "l_orderkey").select("l_orderkey", raters.explorers_agree(F.col("a"), F.col("b")).alias("agree"))


@query("""SELECT o_orderkey AS doc_id, coalesce(nullif(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_custkey END, 0), n)::BIGINT AS people, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority = '' THEN flags ELSE o_orderpriority END AS name
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_returnflag) AS flags FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a first source, with those of a second where they are zero or empty."""
    first = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "O", F.lit(0)).otherwise(F.col("o_custkey")).cast("long").alias("people"),
        F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(F.col("o_orderpriority")).alias("name"))
    second = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("people"), F.min("l_returnflag").alias("name"))
    return structure.merge_facts(first, second)


# Suppliers as versions of standards: those with a debt are superseded by the next one.
_VERSIONS_SQL = "ver AS (SELECT s_suppkey::VARCHAR AS norm, CASE WHEN s_acctbal < 0 THEN 'superseded' ELSE 'current' END AS status, CASE WHEN s_acctbal < 0 THEN (s_suppkey + 1)::VARCHAR END AS superseded_by, (2000 + s_nationkey)::BIGINT AS latest_year FROM supplier)"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = F.col("s_acctbal") < 0
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("norm"), F.when(debt, "superseded").otherwise("current").alias("status"), F.when(debt, (F.col("s_suppkey") + 1).cast("string")).alias("superseded_by"),
        _long(2000 + F.col("s_nationkey")).alias("latest_year"))


@query(f"""WITH {_VERSIONS_SQL} SELECT l_orderkey, tag, v.norm IS NOT NULL AS found, coalesce(v.status, 'unknown') AS status, v.latest_year, v.superseded_by
FROM (SELECT DISTINCT l_orderkey, (l_suppkey + l_linenumber)::VARCHAR AS tag FROM lineitem) LEFT JOIN ver v ON v.norm = tag""")
def validated_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different reference with whether it exists, its status and its latest year."""
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + F.col("l_linenumber")).cast("string").alias("tag"))
    return references.validated(refs, _versions(spark, sf_dir), ["l_orderkey"])


@query(f"""WITH {_VERSIONS_SQL}, c AS (SELECT l_orderkey AS doc_id, (l_suppkey + l_linenumber)::VARCHAR AS raw, year(l_shipdate) AS y FROM lineitem),
k AS (SELECT doc_id, raw, CASE WHEN norm IS NULL THEN 'untraceable' WHEN status = 'superseded' OR y < latest_year THEN 'outdated' END AS kind FROM c LEFT JOIN ver ON norm = raw)
SELECT doc_id, coalesce(string_agg(raw, ',' ORDER BY raw) FILTER (kind = 'outdated'), '') AS outdated, coalesce(string_agg(raw, ',' ORDER BY raw) FILTER (kind = 'untraceable'), '') AS untraceable, count(*) AS total FROM k WHERE kind IS NOT NULL GROUP BY doc_id""")
def version_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outdated and the untraceable references of each document."""
    raw = (F.col("l_suppkey") + F.col("l_linenumber")).cast("string")
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), raw.alias("raw"), raw.alias("norm"), F.year("l_shipdate").alias("year"))
    found = references.version_findings(cited, _versions(spark, sf_dir), ["doc_id"])
    join = lambda c: F.array_join(c, ",").alias(c)
    return references.version_summary(found).select("doc_id", join("outdated"), join("untraceable"), "total")


@query("""SELECT l_orderkey AS doc_id, chr((65 + l_suppkey % 26)::INT) AS tag, count(*) AS n, chr((65 + l_suppkey % 26)::INT) IN ('A', 'E', 'I', 'O', 'U') AS defined FROM lineitem GROUP BY 1, 2""")
def reference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to appendices in texts, counted by tag, with whether the appendix is there."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.lit("").alias("title"), F.concat(F.lit("见 附录 "), F.chr(65 + F.col("l_suppkey") % 26)).alias("content"))
    anchors = rows.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(x) for x in "AEIOU"])).alias("label"))
    return references.reference_summary(rows, anchors).where("kind = 'appendix'").select("doc_id", "tag", "n", "defined")


@query("""WITH t AS (SELECT conv_id AS doc_id, turn AS pos, role = 'system' AS opens, role = 'user' AS titled FROM conversations),
s AS (SELECT *, max(opens::INT) OVER w AS started FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
e AS (SELECT *, coalesce(max(CASE WHEN started = 1 AND titled THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS ended FROM s)
SELECT doc_id, pos FROM e WHERE started = 1 AND ended = 0""")
def reference_section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a section, from the title that names it to the next titled row."""
    title = F.when(F.col("role") == "system", "规范性引用文件").when(F.col("role") == "user", "other")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), title.alias("title"), F.col("text").alias("content"))
    return references.reference_section(rows).select("doc_id", "pos")


_SUFFIX = {"en": ".docx", "fr": ".pdf", "de": ".DOC", "es": ".txt"}


@query("""SELECT doc_id, CASE WHEN lang <> 'es' AND n_chars >= 100 THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN lang <> 'es' AND n_chars >= 100 THEN 4 ELSE 0 END::BIGINT AS score,
100::BIGINT AS confidence, CASE WHEN lang = 'es' THEN 'T2.format' WHEN n_chars < 100 THEN 'T2.parse_failure' END AS rule_id FROM documents""")
def format_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's format is supported and it was parsed (the format goes by language)."""
    suffix = tx.first_match(F.col("lang"), [(F.col("lang") == k, F.lit(v)) for k, v in _SUFFIX.items()])
    return table(spark, sf_dir, "documents").select("doc_id", registry.format_result(suffix, F.col("n_chars") >= 100).alias("r")).select("doc_id", "r.*")


_BLOCKS = {"law": ["License"], "mail": ["@"], "word": [" the ", " der ", " les ", " las "]}


@query("""WITH x AS (SELECT doc_id, coalesce(text, '') AS t, (contains(text, 'License')::INT + contains(text, '@')::INT + (contains(text, ' the ') OR contains(text, ' der ') OR contains(text, ' les ') OR contains(text, ' las '))::INT) AS k FROM documents)
SELECT doc_id, k::BIGINT AS n_blocks, CASE WHEN trim(t) = '' THEN 'uncertain' WHEN k = 0 THEN 'fail' WHEN k = 3 THEN 'pass' WHEN k / 3 >= 0.66 THEN 'partial' ELSE 'fail' END AS verdict,
CASE WHEN trim(t) = '' THEN 0 WHEN k = 0 THEN 3 WHEN k = 3 THEN 10 WHEN k / 3 >= 0.66 THEN 7 ELSE 4 END::BIGINT AS score FROM x""")
def block_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text describes each of the blocks of a template."""
    rows = consistency.three_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"), _BLOCKS)
    return rows.select("doc_id", _long(F.size("snippets")).alias("n_blocks"), "verdict", "score")


@query("""SELECT doc_id, contains(text, 'License') AS cited, (contains(text, 'password')::INT + contains(text, '@')::INT)::BIGINT AS n_related,
CASE WHEN trim(text) = '' THEN 'uncertain' WHEN contains(text, 'License') THEN 'pass' ELSE 'fail' END AS verdict FROM documents""")
def required_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text cites what it must, with what else it cites."""
    rows = consistency.required_standard(table(spark, sf_dir, "documents").select("doc_id", "text"), ["License"], ["password", "@"])
    return rows.select("doc_id", "cited", _long(F.size("related")).alias("n_related"), "verdict")


_PREFIXES = ["TSG", "AQ", "GBT", "GB", "QSY", "SYT", "NBT", "ISO"]


@query("SELECT s_suppkey, CASE (s_suppkey % 8)::INT " + " ".join(f"WHEN {i} THEN '{dict(DOCUMENT_TYPES).get(p, 'OTHER')}'" for i, p in enumerate(_PREFIXES)) + " END AS doc_type FROM supplier")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of documents by the first prefix of their name that fits."""
    name = F.concat(F.lower(F.get(F.array(*[F.lit(p) for p in _PREFIXES]), (F.col("s_suppkey") % 8).cast("int"))), F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", registry.document_type(name).alias("doc_type"))


@query("SELECT conv_id AS doc_id, md5(string_agg(role || CASE WHEN trim(text) = '' THEN '' ELSE chr(10) || trim(text) END, chr(10) ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and bodies of a document's rows in order, as one text."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("role").alias("title"), F.col("text").alias("content"))
    return consistency.document_text(rows).select("doc_id", F.md5("text").alias("text"))


@query("SELECT o_orderkey, regexp_extract(upper(replace('hca_cpy-' || o_orderkey || '_' || o_orderstatus, '_', '')), '(CPY-[0-9]{3,4}(-[A-Z0-9]{2,20})*)', 1) AS code FROM orders")
def codes_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in document ids, underscores left out; the empty text without one."""
    ident = F.concat(F.lit("hca_cpy-"), F.col("o_orderkey").cast("string"), F.lit("_"), "o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(consistency.code_of_id(ident), F.lit("")).alias("code"))


@query("""SELECT conv_id AS doc_id, CASE WHEN NOT bool_or(role = 'user' AND length(text) > 60) AND NOT bool_or(role = 'assistant' AND length(text) > 60) THEN 'both' WHEN NOT bool_or(role = 'user' AND length(text) > 60) THEN 'main'
WHEN NOT bool_or(role = 'assistant' AND length(text) > 60) THEN 'appendix' ELSE 'none' END AS missing_side FROM conversations GROUP BY conv_id""")
def missing_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side of a pair of texts a document lacks."""
    has = lambda role: F.bool_or((F.col("role") == role) & (F.length("text") > 60))
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(consistency.missing_side(has("user"), has("assistant")).alias("missing_side"))


@query("SELECT doc_id, len(s)::BIGINT AS n_steps, md5(array_to_string(s, '|')) AS steps FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)")
def cleaned_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of steps trimmed, blank ones left out."""
    rows = table(spark, sf_dir, "documents").select("doc_id", consistency.clean_steps(F.split("text", "\n")).alias("s"))
    return rows.select("doc_id", _long(F.size("s")).alias("n_steps"), F.md5(F.array_join("s", "|")).alias("steps"))


@query("""SELECT l_orderkey, string_agg(l_quantity::INT::VARCHAR, ',' ORDER BY l_linenumber, l_quantity) FILTER (l_linenumber % 2 = 0) AS km, string_agg(l_quantity::INT::VARCHAR, ',' ORDER BY l_linenumber, l_quantity) FILTER (l_linenumber % 2 = 1) AS kg FROM lineitem GROUP BY l_orderkey""")
def numbers_with_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers before each unit in a text."""
    piece = F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, " km").otherwise(" kg"))
    texts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", piece.alias("p")))), lambda x: x["p"]), ", ").alias("text"))
    found = texts.select("l_orderkey", consistency.numbers_with_units(F.col("text"), ["km", "kg"]).alias("m"))
    listed = lambda u: F.array_join(F.transform(F.try_element_at("m", F.lit(u)), lambda x: x.cast("int").cast("string")), ",").alias(u)
    return found.select("l_orderkey", listed("km"), listed("kg"))


@query(f"WITH {_FINDINGS_SQL} SELECT source, count(*) AS total, count(*) FILTER (verdict <> 'pass') AS human_review, count(*) FILTER (verdict = 'fail') AS failed FROM v GROUP BY source")
def batch_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of whole batches: documents, reviews, failures."""
    rows = _structure_results(spark, sf_dir).select("source", F.col("verdict").alias("overall_verdict"), (F.col("verdict") != "pass").alias("need_review"))
    return raters.batch_summary(rows, ["source"])


@query("""WITH d AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'purchase')), x AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, coalesce((SELECT string_agg(event_type, ',' ORDER BY event_type) FROM d WHERE d.user_id = x.user_id), '') AS completed,
coalesce((SELECT CASE WHEN count(*) > 0 THEN 'error' END FROM events e WHERE e.user_id = x.user_id AND event_type = 'error'), '') AS failed FROM x""")
def sessions_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with the steps that events finish or fail, each once."""
    rows = table(spark, sf_dir, "events")
    none = F.array().cast("array<string>")
    state = rows.select(F.col("user_id").alias("doc_id")).distinct().withColumns({"completed": none, "failed": none})
    ok = F.when(F.col("event_type") == "error", False).otherwise(True)
    finished = rows.where(F.col("event_type").isin("click", "purchase", "error")).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("dimension"), ok.alias("ok"))
    return raters.marked_done(state, finished).select(F.col("doc_id").alias("user_id"), F.array_join("completed", ",").alias("completed"), F.array_join("failed", ",").alias("failed"))


@query("""WITH dims AS (SELECT * FROM (VALUES ('click', 'rule', false), ('purchase', 'llm', false), ('view', 'llm', true), ('audit', 'c5', false)) AS t(dimension, grp, img)),
u AS (SELECT user_id, bool_or(event_type = 'error') AS has_images FROM events GROUP BY 1)
SELECT user_id, dimension, grp FROM u CROSS JOIN dims d WHERE (u.has_images OR NOT d.img) AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = d.dimension AND e.value > 50)""")
def remaining_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run still has to do, by group; image dimensions only where there are images."""
    rows = table(spark, sf_dir, "events")
    dims = spark.createDataFrame([("click", "rule", False), ("purchase", "llm", False), ("view", "llm", True), ("audit", "c5", False)], "dimension string, `group` string, needs_images boolean")
    docs = rows.groupBy(F.col("user_id").alias("doc_id")).agg(F.bool_or(F.col("event_type") == "error").alias("has_images"))
    done = rows.where("value > 50").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("dimension")).distinct()
    return raters.remaining(docs, dims, done).select(F.col("doc_id").alias("user_id"), "dimension", F.col("group").alias("grp"))


@query(f"""WITH {_FINDINGS_SQL} SELECT 'T1' AS metric, doc_id, verdict FROM v UNION ALL
SELECT 'T2', doc_id, CASE WHEN lang <> 'es' AND n_chars >= 100 THEN 'pass' ELSE 'fail' END FROM documents UNION ALL
SELECT 'T3', doc_id, CASE WHEN n_chars <= 2000 THEN 'pass' WHEN n_chars <= 4000 THEN 'partial' ELSE 'fail' END FROM documents""")
def all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of a run as one relation (the length stands for the time)."""
    t1 = _structure_results(spark, sf_dir).select(F.lit("T1").alias("metric"), "doc_id", "verdict")
    t2 = format_compatibility(spark, sf_dir).select(F.lit("T2").alias("metric"), "doc_id", "verdict")
    tier = F.when(F.col("n_chars") <= 2000, "pass").when(F.col("n_chars") <= 4000, "partial").otherwise("fail")
    t3 = table(spark, sf_dir, "documents").select(F.lit("T3").alias("metric"), "doc_id", tier.alias("verdict"))
    return t1.unionByName(t2).unionByName(t3)


@query(f"""WITH {_FINDINGS_SQL}, r AS (SELECT doc_id, 'rule' AS origin, severity FROM f WHERE severity IS NOT NULL UNION ALL SELECT doc_id, 'model', 'high' FROM labels WHERE toxic = 1)
SELECT doc_id, count(*) AS n, count(*) FILTER (origin = 'model') AS n_model FROM r GROUP BY doc_id""")
def mixed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of rules and of a model as one bag."""
    rules = keyword_findings(table(spark, sf_dir, "documents").select("doc_id", "text"), SEVERITY_WORDS).where("severity is not null").select("doc_id", F.lit("rule").alias("origin"), "severity")
    model = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("model").alias("origin"), F.lit("high").alias("severity"))
    return rules.unionByName(model).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("origin") == "model").alias("n_model"))


@query("""WITH a AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS x FROM events WHERE value <= 20 GROUP BY 1), b AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS y FROM events WHERE value > 20 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, array_to_string(list_concat(coalesce(x, []), list_filter(coalesce(y, []), lambda e: NOT list_contains(coalesce(x, []), e))), ',') AS names FROM a FULL JOIN b ON a.user_id = b.user_id""")
def names_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that two sources give, each once, those of the first in front."""
    rows = table(spark, sf_dir, "events")
    side = lambda test, name: rows.where(test).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias(name))
    none = F.array().cast("array<string>")
    both = side("value <= 20", "a").join(side("value > 20", "b"), "user_id", "full")
    return both.select("user_id", F.array_join(consistency.merged_names(F.coalesce("a", none), F.coalesce("b", none)), ",").alias("names"))


@query(f"""WITH {_FINDINGS_SQL}, w AS (SELECT v.doc_id, v.verdict AS v1, v.confidence AS c1, CASE WHEN l.toxic = 1 THEN 'fail' ELSE 'pass' END AS v4 FROM v JOIN labels l USING (doc_id))
SELECT doc_id, 'C1_structure' AS dimension, v1 AS verdict, greatest(0, c1 - CASE WHEN v1 = 'pass' AND v4 = 'fail' THEN 15 ELSE 0 END)::BIGINT AS confidence FROM w UNION ALL SELECT doc_id, 'C4_reference', v4, 80 FROM w""")
def downgraded_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passed dimension loses confidence where the one that contradicts it failed."""
    labels = table(spark, sf_dir, "labels")
    first = _structure_results(spark, sf_dir).join(labels.select("doc_id"), "doc_id").select("doc_id", F.lit("C1_structure").alias("dimension"), "verdict", "confidence")
    second = labels.select("doc_id", F.lit("C4_reference").alias("dimension"), F.when(F.col("toxic") == 1, "fail").otherwise("pass").alias("verdict"), _long(F.lit(80)).alias("confidence"))
    return raters.downgraded(first.unionByName(second), ["doc_id"], [("C1_structure", "C4_reference")]).select("doc_id", "dimension", "verdict", "confidence")



@query("""WITH d AS (SELECT o_orderkey, o_orderdate AS a, min(l_shipdate) AS b, max(l_shipdate) FILTER (l_returnflag = 'R') AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate),
f AS (SELECT o_orderkey, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n, coalesce(a > b, false) OR coalesce(a > c, false) OR coalesce(b > c, false) AS inv,
len(list_distinct(list_filter([year(a), year(b), year(c)], lambda y: y IS NOT NULL))) > 1 AS many FROM d)
SELECT o_orderkey, n::BIGINT AS n_dates, inv AS inverted, many AS many_years, CASE WHEN n < 2 THEN 'uncertain' WHEN inv THEN 'fail' WHEN many THEN 'partial' ELSE 'pass' END AS verdict FROM f""")
def step_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the steps of each order follow each other: ordered, first shipped, last returned goods shipped."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").alias("shipped"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("returned"))
    dates = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ordered")).join(lines, "o_orderkey", "left")
    found = evaluators.time_order(dates, "o_orderkey", ["ordered", "shipped", "returned"])
    return found.withColumn("n_dates", _long(F.col("n_dates")))


@query("""WITH t AS (SELECT conv_id AS doc_id, turn AS pos, trim(text) AS t FROM conversations WHERE trim(text) <> '' AND (contains(text, 'the') OR contains(text, 'los') OR contains(role, 'system'))),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM t)
SELECT doc_id, count(*) AS n_rows, md5(string_agg(t, chr(10) || '---' || chr(10) ORDER BY pos)) AS text FROM r WHERE rn <= 8 GROUP BY doc_id""")
def named_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight rows of each document that name something in their text or title, as one text."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("role").alias("title"), F.col("text").alias("content"))
    found = images.area_description(rows, words=["the", "los"], titles=["system"])
    return found.select("doc_id", "n_rows", F.md5("text").alias("text"))


@query("""WITH s AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM
(SELECT conv_id AS doc_id, string_agg(CASE role WHEN 'system' THEN '# ' WHEN 'user' THEN '## ' ELSE '' END || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)),
l AS (SELECT *, length(regexp_extract(line, '^(#{1,4}) ', 1)) AS level, CASE WHEN regexp_extract(line, '^(#{1,4}) ', 1) <> '' THEN trim(regexp_replace(line, '^#{1,4} ', '')) END AS head FROM s),
n AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section, last_value(CASE WHEN level = 1 THEN head END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM l),
g AS (SELECT doc_id, section, max(level) AS level, max(head) AS title, max(chapter) AS chapter, trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), '')) AS content FROM n GROUP BY doc_id, section)
SELECT doc_id, section::BIGINT AS section, level::BIGINT AS level, md5(title) AS title, md5(chapter) AS chapter, md5(substring(content, 1, 2000)) AS content FROM g WHERE section > 0 AND length(content) >= 60""")
def sections_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as Markdown and split at their headings."""
    mark = F.when(F.col("role") == "system", "# ").when(F.col("role") == "user", "## ").otherwise("")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(mark, "text").alias("t"))))
    docs = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("text"))
    found = chunking.markdown_sections(docs, ["doc_id"], "text")
    return found.select("doc_id", _long(F.col("section")).alias("section"), _long(F.col("level")).alias("level"), *[F.md5(c).alias(c) for c in ("title", "chapter", "content")])
