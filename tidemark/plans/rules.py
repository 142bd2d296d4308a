"""Rule queries: raters, versions, requirements, joins of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.queries import query
from tidemark.session import small, table

_RATERS = """a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS verdict, 10 + doc_id % 3 AS score, 40 + doc_id % 60 AS confidence FROM labels),
b AS (SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'partial' WHEN lang = 'fr' THEN 'uncertain' WHEN n_chars > 300 THEN 'pass' ELSE 'fail' END AS verdict, 8 + doc_id % 4 AS score, 45 + doc_id % 50 AS confidence FROM documents WHERE n_chars >= 200),
m AS (SELECT doc_id, a.verdict AS av, b.verdict AS bv, a.score AS asc_, b.score AS bsc, a.confidence AS ac, b.confidence AS bc,
CASE a.verdict WHEN 'fail' THEN 3 WHEN 'partial' THEN 2 WHEN 'uncertain' THEN 1 ELSE 0 END >= CASE b.verdict WHEN 'fail' THEN 3 WHEN 'partial' THEN 2 WHEN 'uncertain' THEN 1 ELSE 0 END AS a_first
FROM a FULL JOIN b USING (doc_id)),
r AS (SELECT doc_id, CASE WHEN av IS NULL THEN bv WHEN bv IS NULL OR av = bv OR a_first THEN av ELSE bv END AS verdict,
CASE WHEN av IS NULL THEN bsc WHEN bv IS NULL THEN asc_ WHEN av = bv THEN (asc_ + bsc) // 2 WHEN a_first THEN asc_ ELSE bsc END::BIGINT AS score,
CASE WHEN av IS NULL THEN bc WHEN bv IS NULL THEN ac WHEN av = bv THEN (ac + bc) // 2 ELSE least(70, CASE WHEN a_first THEN ac ELSE bc END) END::BIGINT AS confidence,
CASE WHEN bv IS NULL THEN 'a_only' WHEN av IS NULL THEN 'b_only' WHEN av = bv THEN 'agree' ELSE 'diverge' END AS source_tag FROM m)"""


def _raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, i = table(spark, sf_dir, "labels"), F.col("doc_id")
    good = F.col("quality") == 1
    a = labels.select("doc_id", F.when(good, "pass").otherwise("fail").alias("verdict"), (10 + i % 3).alias("score"), (40 + i % 60).alias("confidence"))
    # the second rater says nothing about very short documents, and the first has seen labelled ones only
    n = F.col("n_chars")
    verdict = F.when(n > 5000, "partial").when(F.col("lang") == "fr", "uncertain").when(n > 300, "pass").otherwise("fail")
    b = table(spark, sf_dir, "documents").where(n >= 200).select("doc_id", verdict.alias("verdict"), (8 + i % 4).alias("score"), (45 + i % 50).alias("confidence"))
    return folds.merge_raters(a, b, ["doc_id"])


@query(f"WITH {_RATERS} SELECT doc_id, verdict, score, confidence, source_tag, source_tag <> 'agree' OR confidence < 50 AS need_review FROM r")
def rater_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters merged; what one of them lacks is taken from the other."""
    return _raters(spark, sf_dir)


@query(f"WITH {_RATERS} SELECT source_tag, count(*) AS n, count(*) FILTER (source_tag = 'diverge') BETWEEN 1 AND 6 AS to_arbiter FROM r GROUP BY source_tag")
def divergence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model arbitrates only where one to six dimensions diverge."""
    diverging = F.count_if(F.col("source_tag") == "diverge")
    return _raters(spark, sf_dir).groupBy("source_tag").agg(F.count(F.lit(1)).alias("n"), diverging.between(1, 6).alias("to_arbiter"))


@query("""SELECT doc_id, quality = 1 AND toxic = 1 AS conflict, quality = 0 AND toxic = 1 AS both_bad,
CASE WHEN quality = 1 AND toxic = 1 THEN greatest(0, 80 - 15) ELSE 80 END::BIGINT AS confidence, (quality = 1 AND toxic = 1) OR doc_id % 13 = 0 AS need_review FROM labels""")
def cross_dim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradicting dimensions lower the confidence and ask for a review."""
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    confidence = F.when(q & t, F.greatest(F.lit(0), F.lit(80 - 15))).otherwise(80).cast("long")
    return table(spark, sf_dir, "labels").select(
        "doc_id", (q & t).alias("conflict"), (~q & t).alias("both_bad"), confidence.alias("confidence"), ((q & t) | (F.col("doc_id") % 13 == 0)).alias("need_review"))


@query("""SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'pass' WHEN quality = 1 THEN 'uncertain' ELSE 'fail' END AS verdict,
CASE WHEN quality = 1 AND toxic = 0 THEN false WHEN quality = 1 THEN doc_id % 2 > 0 ELSE true END AS is_problem FROM labels""")
def verdict_is_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a verdict is a problem; an uncertain one is, if it has findings."""
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "pass").when(F.col("quality") == 1, "uncertain").otherwise("fail")
    rows = table(spark, sf_dir, "labels").select("doc_id", verdict.alias("verdict"), (F.col("doc_id") % 2).alias("n_findings"))
    problem = F.when(F.col("verdict") == "pass", False).when(F.col("verdict") == "uncertain", F.col("n_findings") > 0).otherwise(True)
    return rows.select("doc_id", "verdict", problem.alias("is_problem"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s_suppkey IS NULL THEN 'untraceable' WHEN s_acctbal < 0 THEN 'superseded' WHEN year(l_shipdate) < 1992 + s_nationkey % 4 THEN 'older' ELSE 'current' END AS kind,
CASE WHEN s_suppkey IS NULL THEN 'low' WHEN s_acctbal < 0 THEN 'high' WHEN year(l_shipdate) < 1992 + s_nationkey % 4 THEN 'medium' END AS severity
FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey + l_linenumber""")
def version_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations against versions: unknown ones are untraceable, others superseded, older or current."""
    versions = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cited"), "s_acctbal", "s_nationkey", F.lit(True).alias("known"))
    cited = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") + F.col("l_linenumber")).alias("cited"), "l_shipdate").join(versions, "cited", "left")
    older = F.year("l_shipdate") < 1992 + F.col("s_nationkey") % 4
    kind = F.when(F.col("known").isNull(), "untraceable").when(F.col("s_acctbal") < 0, "superseded").when(older, "older").otherwise("current")
    rows = cited.select("l_orderkey", "l_linenumber", kind.alias("kind"))
    severity = F.create_map(*[F.lit(x) for x in ("untraceable", "low", "superseded", "high", "older", "medium")])
    return rows.select("*", F.try_element_at(severity, "kind").alias("severity"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) AND EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def anti_unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations that a reference section does not list, if there is such a section."""
    listed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    exists = listed.limit(1).select(F.lit(1).alias("_one"))
    parts = table(spark, sf_dir, "part").select("p_partkey").join(listed, "p_partkey", "left_anti")
    return parts.withColumn("_one", F.lit(1)).join(exists, "_one", "left_semi").drop("_one")


@query("""WITH need AS (SELECT user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events), (VALUES ('signup'), ('error'), ('click'), ('view'), ('purchase')) t(event_type) WHERE user_id % 3 > 0 OR t.event_type <> 'error'),
x AS (SELECT n.user_id, count(*) AS n_required, count(*) FILTER (e.event_type IS NULL) AS n_missing FROM need n LEFT JOIN (SELECT DISTINCT user_id, event_type FROM events WHERE value > 80) e
ON e.user_id = n.user_id AND e.event_type = n.event_type GROUP BY n.user_id)
SELECT user_id, n_required, n_missing, CASE WHEN n_missing = 0 THEN 'pass' WHEN n_missing <= n_required // 2 THEN 'partial' ELSE 'fail' END AS verdict FROM x""")
def required_minus_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required kinds (one of them on a condition) minus those present, on a ladder."""
    events = table(spark, sf_dir, "events")
    kinds = F.array(*[F.lit(x) for x in ("signup", "error", "click", "view", "purchase")])
    need = events.select("user_id").distinct().select("user_id", F.explode(kinds).alias("event_type")).where("user_id % 3 > 0 OR event_type <> 'error'")
    present = events.where("value > 80").select("user_id", "event_type", F.lit(True).alias("present")).distinct()
    x = need.join(present, ["user_id", "event_type"], "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_required"), F.count_if(F.col("present").isNull()).alias("n_missing"))
    verdict = F.when(F.col("n_missing") == 0, "pass").when(F.col("n_missing") <= F.floor(F.col("n_required") / 2), "partial").otherwise("fail")
    return x.select("*", verdict.alias("verdict"))


@query("""SELECT d.doc_id, CASE WHEN strpos(d.text, 'the') > 0 THEN substring(d.text, greatest(1, strpos(d.text, 'the') - 20), 40) ELSE substring(d.text, 1, 100) END AS highlight, coalesce(l.quality, -1) AS quality
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def enrich_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window around the anchor, else the beginning; missing fields filled from the other table."""
    at = F.instr("text", "the")
    around = F.when(at > 0, F.expr("substring(text, greatest(1, instr(text, 'the') - 20), 40)")).otherwise(F.substring("text", 1, 100))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return table(spark, sf_dir, "documents").select("doc_id", around.alias("highlight")).join(labels, "doc_id", "left").select("doc_id", "highlight", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("""SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) t
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.event_type AND e.value > 100)""")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of each task that are not done: all of them (a fixed few) minus the completed."""
    events = table(spark, sf_dir, "events")
    done = events.where("value > 100").select("user_id", "event_type")
    every = events.select("user_id").distinct().crossJoin(small(events.select("event_type").distinct()))
    return every.join(done, ["user_id", "event_type"], "left_anti")


@query("""WITH t AS (SELECT user_id, list_distinct(list(event_type) FILTER (value > 100)) AS a, list_distinct(list(event_type) FILTER (value < 5)) AS b FROM events GROUP BY user_id)
SELECT user_id, len(list_distinct(list_concat(coalesce(a, []), coalesce(b, []))))::BIGINT AS n_union, len(list_intersect(coalesce(a, []), coalesce(b, [])))::BIGINT AS n_both,
len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)))::BIGINT AS n_only_a, len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x)))::BIGINT AS n_only_b FROM t""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and both differences of two sets of kinds."""
    pick = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(pick(F.col("value") > 100).alias("a"), pick(F.col("value") < 5).alias("b"))
    n = lambda c, name: F.size(c).cast("long").alias(name)
    return sets.select("user_id", n(F.array_union("a", "b"), "n_union"), n(F.array_intersect("a", "b"), "n_both"), n(F.array_except("a", "b"), "n_only_a"), n(F.array_except("b", "a"), "n_only_b"))
