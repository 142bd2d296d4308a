"""Queries over conversations as ordered sequences of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import sequence as seq
from tidemark.queries import query
from tidemark.session import table

WORDS = ["the", "les"]


@query("""SELECT conv_id, turn, rn, excerpt FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY rn) AS used, substring(text, 1, 600) AS excerpt FROM
(SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY (contains(text, 'the') OR contains(text, 'les')) DESC, turn) AS rn FROM conversations) WHERE rn <= 40)
WHERE used <= 600 OR rn = 1""")
def priority_char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with keywords first, up to 40 rows and 600 characters."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return seq.priority_budget(rows, ["conv_id"], tx.any_of(F.col("text"), WORDS), ["turn"], 40, 600, "text").select("conv_id", "turn", "rn", "excerpt")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 500")
def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading rows whose characters fit 500."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return seq.within_budget(rows, ["conv_id"], ["turn"], F.length("text"), 500).select("conv_id", "turn")


@query("""SELECT conv_id, substring(string_agg(trim(text), '' ORDER BY turn), 1, 200) AS summary FROM
(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 8 GROUP BY conv_id""")
def doc_summary_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight rows, trimmed, cut to 200 characters together."""
    first = seq.top(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim("text").alias("t")), ["conv_id"], ["turn"], 8)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "")
    return first.groupBy("conv_id").agg(F.substring(parts, 1, 200).alias("summary"))


@query("""SELECT conv_id, session_id::BIGINT AS session_id, count(*) AS n_rows, sum(length(text))::BIGINT AS chars, min_by(substring(text, 1, 20), turn) AS title FROM
(SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS session_id FROM conversations) GROUP BY conv_id, session_id""")
def section_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user row opens a section; the section is titled by its first row."""
    rows = seq.sessions(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")
    return rows.groupBy("conv_id", "session_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).cast("long").alias("chars"),
                                                     F.min_by(F.substring("text", 1, 20), "turn").alias("title"))


@query("""SELECT conv_id, turn, prev_user, next_user FROM (SELECT *, last_value(u IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prev_user,
first_value(u IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_user
FROM (SELECT *, CASE WHEN role = 'user' THEN substring(text, 1, 40) END AS u FROM conversations)) WHERE role = 'assistant'""")
def asof_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user rows before and after each assistant row, in order."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.substring("text", 1, 40)).alias("u"))
    return seq.nearest(rows, ["conv_id"], ["turn"], F.col("u"), "prev_user", "next_user").where("role = 'assistant'").select("conv_id", "turn", "prev_user", "next_user")


@query("""SELECT conv_id, min_by(text, turn) AS first_text, max_by(role, turn) AS last_role, count(DISTINCT role) AS n_roles FROM conversations GROUP BY conv_id""")
def section_first_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("first_text"), F.max_by("role", "turn").alias("last_role"), F.count_distinct("role").alias("n_roles"))


_KINDS = {"the": ["the", "and"], "les": ["les", "et"], "der": ["der", "und"]}


def _score_sql(k: str) -> str:
    h = lambda t: "(" + " + ".join(f"contains({t}, '{w}')::INT" for w in _KINDS[k]) + ")"
    return f"3 * {h('text')} + 2 * {h('p')} + {h('n')}"


@query("WITH x AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER w, '') AS p, coalesce(lead(text) OVER w, '') AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
       "s AS (SELECT conv_id, turn, " + ", ".join(f"({_score_sql(k)})::BIGINT AS s{i}" for i, k in enumerate(_KINDS)) + " FROM x) "
       "SELECT conv_id, turn, s0, s1, s2, CASE WHEN greatest(s0, s1, s2) = 0 THEN NULL WHEN s0 >= greatest(s1, s2) THEN 'the' WHEN s1 >= s2 THEN 'les' ELSE 'der' END AS kind FROM s")
def weighted_context_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind by three times own hits, twice those of the row before and once those of the row after."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.coalesce(F.lag("text").over(w), F.lit("")).alias("p"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("n"))
    score = lambda ws: 3 * tx.hits(F.col("text"), ws) + 2 * tx.hits(F.col("p"), ws) + tx.hits(F.col("n"), ws)
    s = x.select("conv_id", "turn", *[score(ws).alias(f"s{i}") for i, ws in enumerate(_KINDS.values())])
    # the first kind wins a tie
    best = F.array_max(F.array(*[F.struct(F.col(f"s{i}").alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(_KINDS)]))
    return s.select("*", F.when(best["s"] > 0, best["k"]).alias("kind"))


@query("SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system')")
def semi_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the conversations that have a system row."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn").join(rows.where("role = 'system'").select("conv_id"), "conv_id", "left_semi")


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'reference' WHEN contains(lower(text), 'and') THEN 'appendix' ELSE 'main' END AS side,
floor(length(text) * 1.4::DOUBLE)::BIGINT AS est_tokens FROM conversations""")
def appendix_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text against appendix candidates, by role and words."""
    side = F.when(F.col("role") == "system", "reference").when(F.lower("text").contains("and"), "appendix").otherwise("main")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", side.alias("side"), tx.est_tokens(F.col("text")).alias("est_tokens"))
