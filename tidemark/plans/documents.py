"""Queries over documents and pages: blocks, tags, keyword findings, folds and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import folds
from tidemark.operators.sequence import placed_within
from tidemark.queries import query
from tidemark.session import table

#: Lexicons of the checked queries: severity -> words. The Chinese lexicons of the rules are in lexicons.py.
SEVERITY_WORDS = {"high": ["password", "disgusting"], "medium": ["License", "pathetic"], "low": ["@", " | "]}
TAG_WORDS = {"law": ["License"], "mail": ["@"], "secret": ["password", "token"], "list": ["|"], "the": [" the "], "der": [" der "], "les": [" les "]}
COVERAGE = {"g1": ["the", "les"], "g2": ["and", "und", "et"], "g3": ["of", "de"], "g4": ["License", "@"], "g5": ["in", "en"]}


def _values(words: dict[str, list[str]]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{w}')" for k, ws in words.items() for w in ws) + ")"


def _lexicon(words: dict[str, list[str]]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("name"), F.lit(w).alias("word")) for k, ws in words.items() for w in ws])


def keyword_findings(docs: DataFrame, words: dict[str, list[str]], name: str = "severity") -> DataFrame:
    """One finding for each lexicon word that a text holds; a document without any has one row of nulls."""
    hit = F.filter(_lexicon(words), lambda k: F.col("text").contains(k["word"]))
    found = docs.withColumn("_k", F.explode_outer(hit))
    return found.withColumns({name: F.col("_k.name"), "keyword": F.col("_k.word")}).drop("_k")


_FINDINGS_SQL = f"""
f AS (SELECT d.doc_id, d.source, k.severity, k.word AS keyword FROM documents d LEFT JOIN {_values(SEVERITY_WORDS)} AS k(severity, word) ON contains(d.text, k.word)),
c AS (SELECT doc_id, source, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l FROM f GROUP BY ALL),
v AS (SELECT *, CASE WHEN h + m + l = 0 THEN 'pass' WHEN h > 0 OR m >= 3 THEN 'fail' ELSE 'partial' END AS verdict,
             CASE WHEN h + m + l = 0 THEN 15 WHEN h > 0 OR m >= 3 THEN 5 WHEN m >= 1 THEN 10 ELSE 13 END AS score,
             CASE WHEN h + m + l = 0 THEN 95 WHEN h > 0 OR m >= 3 THEN 90 WHEN m >= 1 THEN 88 ELSE 85 END AS confidence FROM c)"""


def _structure_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counts = folds.severity_counts(keyword_findings(docs, SEVERITY_WORDS).select("doc_id", "source", "severity"), ["doc_id", "source"])
    return counts.select("*", *folds.structure_verdict())


@query(f"""WITH {_FINDINGS_SQL} SELECT source, CASE WHEN bool_or(verdict = 'fail') THEN 'fail' WHEN bool_and(verdict = 'pass') THEN 'pass' ELSE 'partial' END AS overall_verdict,
sum(score)::BIGINT AS total_score, count(*) AS n_docs FROM v GROUP BY source""")
def flagship_audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword findings of each document, folded to a verdict, rolled up by source."""
    return _structure_results(spark, sf_dir).groupBy("source").agg(*folds.overall(), F.count(F.lit(1)).alias("n_docs"))


@query(f"WITH {_FINDINGS_SQL} SELECT doc_id, h AS n_high, m AS n_medium, l AS n_low, verdict, score::BIGINT AS score, confidence::BIGINT AS confidence FROM v")
def structure_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure_results(spark, sf_dir).select("doc_id", "n_high", "n_medium", "n_low", "verdict", "score", "confidence")


@query(f"""WITH {_FINDINGS_SQL} SELECT doc_id, CASE WHEN h + m + l = 0 THEN 'pass' WHEN h > 0 THEN 'fail' ELSE 'partial' END AS verdict,
CASE WHEN h + m + l = 0 THEN 12 WHEN h > 0 THEN 4 WHEN m > 0 THEN 8 ELSE 10 END::BIGINT AS score,
CASE WHEN h + m + l = 0 THEN 95 WHEN h > 0 THEN 90 WHEN m > 0 THEN least(90, 75 + 2 * m) ELSE least(85, 80 - l) END::BIGINT AS confidence FROM c""")
def language_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure_results(spark, sf_dir).select("doc_id", *folds.language_verdict())


@query(r"""SELECT doc_id, (u.i - 1)::INT AS pos, length(u.line)::INT AS length, floor(length(u.line) * 1.4::DOUBLE)::BIGINT AS est_tokens,
substring(regexp_replace(u.line, '\s+', '', 'g'), 1, 30) AS anchor FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)""")
def doc_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks, with token estimate and anchor."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", F.length("line").alias("length"), tx.est_tokens(F.col("line")).alias("est_tokens"), tx.anchor(F.col("line")).alias("anchor"))


_CELLS = {"h1": r"(?s)<h1[^>]*>(.*?)</h1>", "p": r"(?s)<p[^>]*>(.*?)</p>", "li": r"(?s)<li[^>]*>(.*?)</li>"}


@query("WITH x AS (SELECT page_id, " + ", ".join(f"regexp_extract_all(html, '{p}', 1) AS {t}" for t, p in _CELLS.items()) + " FROM pages) SELECT page_id, "
       + ", ".join(f"len({t})::INT AS n_{t}, coalesce(list_sum(list_transform({t}, lambda c: length(c))), 0)::BIGINT AS chars_{t}" for t in _CELLS)
       + ", length(array_to_string(p[1:20], ' | '))::INT AS first_cells FROM x")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of HTML by tag, and the first twenty joined."""
    pages = table(spark, sf_dir, "pages").select("page_id", *[F.regexp_extract_all("html", F.lit(p), F.lit(1)).alias(t) for t, p in _CELLS.items()])
    chars = lambda t: F.aggregate(t, F.lit(0).cast("long"), lambda a, c: a + F.length(c))
    columns = [x for t in _CELLS for x in (F.size(t).alias(f"n_{t}"), chars(t).alias(f"chars_{t}"))]
    return pages.select("page_id", *columns, F.length(F.array_join(F.slice("p", 1, 20), " | ")).alias("first_cells"))


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache by content hash: the first document of each text."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT page_id, substring(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), 1, 80) AS doc_id FROM pages")
def doc_id_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_id(F.col("url")).alias("doc_id"))


@query(f"""SELECT doc_id, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT k.t FROM {_values(TAG_WORDS)} AS k(t, w) WHERE contains(d.text, k.w))), 'other') AS tags FROM documents d""")
def keyword_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the lexicons with a hit, one default without any."""
    tags = F.array_compact(F.array(*[F.when(tx.any_of(F.col("text"), ws), F.lit(t)) for t, ws in TAG_WORDS.items()]))
    joined = F.array_join(F.array_sort(tags), ",")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(joined == "", "other").otherwise(joined).alias("tags"))


_SECRETS = ("AKIA[0-9A-Z]{16}", r"(password|token)\s*=\s*\S{6,}", "-----BEGIN [A-Z ]*PRIVATE KEY-----")


@query("SELECT source, " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS n_{i}" for i, p in enumerate(_SECRETS)) + ", count(*) AS n_docs FROM documents GROUP BY source")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source that a secret pattern rejects."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        *[F.count_if(F.col("text").rlike(p)).alias(f"n_{i}") for i, p in enumerate(_SECRETS)], F.count(F.lit(1)).alias("n_docs"))


@query("""SELECT source, batch, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM
(SELECT source, n_chars, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10)::BIGINT AS batch FROM documents) GROUP BY source, batch""")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ten documents of a source, in order."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    placed = placed_within(docs, ["source"], F.col("doc_id"), ["doc_id"], F.col("doc_id"))
    rows = placed.select("source", "n_chars", F.floor((F.col("rank") - 1) / 10).alias("batch"))
    return rows.groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT doc_id, lag(doc_id) OVER w AS prev_id, lead(doc_id) OVER w AS next_id, substring(lag(text) OVER w, 1, 30) AS prev_text,
concat(substring(regexp_replace(source, '[^A-Za-z0-9_-]+', '_', 'g'), 1, 30), '_', CASE WHEN row_number() OVER w > 9999 THEN (row_number() OVER w - 1)::VARCHAR ELSE lpad((row_number() OVER w - 1)::VARCHAR, 4, '0') END) AS chunk_id
FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def lag_lead_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours and sequential ids inside a source."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.substring("text", 1, 30).alias("start"))
    placed = placed_within(docs, ["source"], F.col("doc_id"), ["doc_id"], F.struct("doc_id", "start"))
    padded = tx.zero_padded((F.col("rank") - 1).cast("string"), 4)
    return placed.select(
        "doc_id", F.col("before.doc_id").alias("prev_id"), F.col("after.doc_id").alias("next_id"), F.col("before.start").alias("prev_text"),
        F.concat(tx.safe_id(F.col("source"), 30), F.lit("_"), padded).alias("chunk_id"))


_SCENARIOS = {"letter": ["@", "Dear", " you "], "code": ["password", "token", "|", "License"]}


@query("WITH h AS (SELECT doc_id, " + ", ".join("(" + " + ".join(f"contains(text, '{w}')::INT" for w in ws) + f")::BIGINT AS {k}" for k, ws in _SCENARIOS.items())
       + " FROM documents) SELECT doc_id, letter, code, CASE WHEN code >= 2 THEN 'code' WHEN letter >= 1 THEN 'letter' WHEN code = 1 THEN 'code' ELSE 'unknown' END AS scenario, "
       "CASE WHEN greatest(letter, code) = 0 THEN NULL WHEN letter >= code THEN 'letter' ELSE 'code' END AS top_kind FROM h")
def scenario_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario by ordered thresholds of keyword hits, and the kind with most hits (first on a tie)."""
    h = table(spark, sf_dir, "documents").select("doc_id", *[tx.hits(F.col("text"), ws).alias(k) for k, ws in _SCENARIOS.items()])
    scenario = F.when(F.col("code") >= 2, "code").when(F.col("letter") >= 1, "letter").when(F.col("code") == 1, "code").otherwise("unknown")
    top = F.when(F.greatest("letter", "code") == 0, None).when(F.col("letter") >= F.col("code"), "letter").otherwise("code")
    return h.select("doc_id", "letter", "code", scenario.alias("scenario"), top.alias("top_kind"))


@query("WITH g AS (SELECT doc_id, (" + " + ".join("(" + " OR ".join(f"contains(text, '{w}')" for w in ws) + ")::INT" for ws in COVERAGE.values()) + """)::BIGINT AS covered FROM documents)
SELECT doc_id, covered, CASE WHEN covered = 5 THEN 'pass' WHEN covered >= 2 THEN 'partial' ELSE 'fail' END AS template_verdict,
CASE WHEN covered = 5 THEN 4 WHEN covered = 4 THEN 3 WHEN covered >= 2 THEN 2 ELSE 0 END::BIGINT AS template_score,
CASE WHEN covered / 5.0 >= 0.85 THEN 'pass' WHEN covered / 5.0 >= 0.6 THEN 'partial' ELSE 'fail' END AS section_verdict FROM g""")
def coverage_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of keyword groups with a hit, on two ladders."""
    covered = sum((tx.any_of(F.col("text"), ws).cast("long") for ws in COVERAGE.values()), F.lit(0).cast("long"))
    g = table(spark, sf_dir, "documents").select("doc_id", covered.alias("covered"))
    c = F.col("covered")
    return g.select(
        "doc_id", "covered", F.when(c == 5, "pass").when(c >= 2, "partial").otherwise("fail").alias("template_verdict"),
        F.when(c == 5, 4).when(c == 4, 3).when(c >= 2, 2).otherwise(0).cast("long").alias("template_score"),
        F.when(c / 5 >= 0.85, "pass").when(c / 5 >= 0.6, "partial").otherwise("fail").alias("section_verdict"))


@query(f"WITH {_FINDINGS_SQL} SELECT source, severity, count(*) AS n FROM f WHERE severity IS NOT NULL GROUP BY ROLLUP (source, severity)")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by source and severity with subtotals."""
    found = keyword_findings(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), SEVERITY_WORDS).where("severity IS NOT NULL")
    return found.rollup("source", "severity").agg(F.count(F.lit(1)).alias("n"))


_RULES = ["R.password", "R.License", "R.missing"]


@query(f"""WITH {_FINDINGS_SQL}, r AS (SELECT doc_id, rule_id FROM (SELECT DISTINCT doc_id FROM documents), (VALUES {', '.join(f"('{r}')" for r in _RULES)}) AS x(rule_id))
SELECT r.doc_id, r.rule_id, count(f.keyword) AS n_findings, CASE WHEN count(f.keyword) = 0 THEN 'pass' WHEN bool_or(f.severity = 'high') THEN 'fail' ELSE 'partial' END AS verdict
FROM r LEFT JOIN f ON f.doc_id = r.doc_id AND 'R.' || f.keyword = r.rule_id GROUP BY r.doc_id, r.rule_id""")
def label_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each listed rule of each document, whether it has findings or not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    listed = docs.select("doc_id", F.explode(F.array(*[F.lit(r) for r in _RULES])).alias("rule_id"))
    found = keyword_findings(docs, SEVERITY_WORDS).where("keyword IS NOT NULL").select("doc_id", F.concat(F.lit("R."), "keyword").alias("rule_id"), "severity")
    n = F.count("severity")
    return listed.join(found, ["doc_id", "rule_id"], "left").groupBy("doc_id", "rule_id").agg(
        n.alias("n_findings"), F.when(n == 0, "pass").when(F.bool_or(F.col("severity") == "high"), "fail").otherwise("partial").alias("verdict"))


_URL_KINDS = [("top", "#top$"), ("query", r"\?"), ("en", "/en/"), ("de", "/de/")]


@query("SELECT page_id, coalesce(CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{k}'" for k, p in _URL_KINDS)
       + " END, CASE page_id % 3 WHEN 0 THEN 'slot0' WHEN 1 THEN 'slot1' ELSE 'slot2' END) AS kind FROM pages")
def path_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pattern that a path matches, else the kind of its position."""
    by_path = tx.first_match(F.col("url"), [(F.col("url").rlike(p), F.lit(k)) for k, p in _URL_KINDS])
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(by_path, F.concat(F.lit("slot"), (F.col("page_id") % 3).cast("string"))).alias("kind"))


@query("""SELECT doc_id, doc_id % 7 + 1 AS page_number, CASE WHEN length(anchor) > 0 THEN substring(anchor, 1, 30) ELSE substring(text, 1, 30) END AS highlight,
(length(text) > 400 AND NOT contains(text, '|')) AS is_problem FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN substring(text, 5, 60) ELSE '' END AS anchor FROM documents)""")
def location_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of a finding: page from the paragraph, highlight from the anchor, else from the evidence."""
    rows = table(spark, sf_dir, "documents").withColumn("anchor", F.when(F.col("doc_id") % 2 == 0, F.substring("text", 5, 60)).otherwise(""))
    highlight = F.when(F.length("anchor") > 0, F.substring("anchor", 1, 30)).otherwise(F.substring("text", 1, 30))
    return rows.select("doc_id", (F.col("doc_id") % 7 + 1).alias("page_number"), highlight.alias("highlight"),
                       ((F.length("text") > 400) & ~F.col("text").contains("|")).alias("is_problem"))
