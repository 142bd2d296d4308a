"""Store queries: keyed merges, freshness, references, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.queries import query
from tidemark.session import table

_NOW = "2024-06-01"


@query("""WITH n AS (SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_orderdate) AS updated_at, count(*) AS used FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(n.status, 'none') AS status, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 WHEN n.o_custkey IS NULL THEN NULL ELSE 0 END AS created_at, c_nationkey + coalesce(n.used, 0) AS used_count
FROM customer LEFT JOIN n ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 OR n.o_custkey IS NOT NULL""")
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest version of each key, the creation time kept, counters raised."""
    orders = table(spark, sf_dir, "orders")
    versions = orders.select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    stored, fresh = versions.where("o_orderstatus = 'F'"), versions.where("o_orderstatus <> 'F'")  # finished orders are there already
    latest = store.upsert(stored, fresh, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"))
    new = latest.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("long").alias("created_at"))
    customers = table(spark, sf_dir, "customer")
    new = new.join(customers.select("c_custkey"), "c_custkey", "left_semi")
    old = customers.where("c_custkey % 2 = 0").select("c_custkey", F.lit("none").alias("status"), (F.col("c_custkey") * 10).alias("created_at"))
    merged = store.upsert_keeping(old, new, ["c_custkey"], "created_at", F.lit(0).cast("long"))
    counted = store.count_usage(customers.select("c_custkey", F.col("c_nationkey").cast("long").alias("used_count")), orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "used_count")
    return merged.join(counted, "c_custkey").select("c_custkey", "status", "created_at", "used_count")


@query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1997-06-01') BETWEEN 0 AND 29 AS fresh FROM orders")
def freshness_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached rows of under thirty days."""
    age = F.datediff(F.lit("1997-06-01").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(age.between(0, 29), F.lit(False)).alias("fresh"))


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def cross_ref_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of keys, exploded and joined back to its rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    refs = lines.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("refs"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(refs, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select("o_orderkey", F.explode("refs").alias("l_linenumber")).distinct().join(lines.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 77 ORDER BY o_orderdate, o_orderkey")
def ordered_scan_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key in order; the filter reaches the files."""
    return table(spark, sf_dir, "orders").where("o_custkey = 77").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def latest_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five tasks of each user."""
    from tidemark.operators.sequence import top

    return top(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query("""SELECT c.c_mktsegment, count(*) AS total, count(o.o_custkey) AS done, count(*) FILTER (c.c_acctbal < 0) AS errors FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o.o_custkey = c.c_custkey GROUP BY 1""")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, finished and failed tasks of each batch."""
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("done")).distinct()
    tasks = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").join(done, "c_custkey", "left")
    return tasks.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("total"), F.count("done").alias("done"), F.count_if(F.col("c_acctbal") < 0).alias("errors"))


@query("""WITH x AS (SELECT nullif(substring(text, 1, doc_id % 3 * 10), '') AS evidence, doc_id, source FROM documents)
SELECT source, count(evidence) AS with_evidence, count(*) AS n, round_even(count(evidence) / 132.0::DOUBLE * 100, 0)::DOUBLE AS normalised FROM x GROUP BY source""")
def normalised_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw scores against the greatest possible one, rounded half to even."""
    evidence = F.nullif(F.expr("substring(text, 1, int(doc_id % 3 * 10))"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("source", evidence.alias("evidence"))
    return rows.groupBy("source").agg(F.count("evidence").alias("with_evidence"), F.count(F.lit(1)).alias("n"), F.bround(F.count("evidence") / 132 * 100, 0).alias("normalised"))
