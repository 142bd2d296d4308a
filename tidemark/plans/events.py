"""Queries over events, orders and line items: traces, windows, ladders and numeric rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.operators import sequence as seq
from tidemark.queries import query
from tidemark.session import table


@query("SELECT event_type, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS total_k, count(*) AS n FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed field of the open JSON column; broken JSON is null."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total_k"), F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'approval' WHEN 'view' THEN 'hca_aerial' ELSE event_type END AS dimension,
CASE event_type WHEN 'error' THEN 'failure' ELSE 'traffic' END AS category FROM events""")
def dimension_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels renamed by a dictionary, others kept."""
    names = F.create_map(*[F.lit(x) for x in ("click", "approval", "view", "hca_aerial")])
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(names[F.col("event_type")], F.col("event_type")).alias("dimension"),
                                                 F.when(F.col("event_type") == "error", "failure").otherwise("traffic").alias("category"))


@query("""WITH x AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, 1 + floor(value)::BIGINT % 4 AS level FROM events)
SELECT user_id, pos, level, CASE level WHEN 2 THEN max(CASE WHEN level < 2 THEN pos END) OVER w WHEN 3 THEN max(CASE WHEN level < 3 THEN pos END) OVER w WHEN 4 THEN max(CASE WHEN level < 4 THEN pos END) OVER w END AS parent_pos
FROM x WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def parent_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent of a heading: the last earlier one of a lower level."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (1 + F.floor("value") % 4).alias("level"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = rows.withColumn("pos", place.cast("long"))
    before = Window.partitionBy("user_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parents = F.array(*[F.max(F.when(F.col("level") < above, F.col("pos"))).over(before) for above in range(1, 5)])
    return rows.select("user_id", "pos", "level", F.get(parents, (F.col("level") - 1).cast("int")).alias("parent_pos"))


@query("""WITH s AS (SELECT user_id, floor(epoch(ts))::BIGINT - 60 AS a, floor(epoch(ts))::BIGINT + 60 AS b FROM events),
o AS (SELECT *, a > coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a - 1) AS opens FROM s),
i AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT user_id, min(a) AS island_start, max(b) AS island_end, count(*) AS n_spans FROM i GROUP BY user_id, island""")
def span_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of the minutes around each user's events."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return seq.islands(table(spark, sf_dir, "events").select("user_id", (at - 60).alias("a"), (at + 60).alias("b")), ["user_id"], "a", "b")


@query("""SELECT path, row_number() OVER (ORDER BY k, n) AS rank FROM (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_orderkey::VARCHAR || '.' || l_linenumber::VARCHAR AS path FROM lineitem)""")
def natural_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section paths in the order of their numbers, all as one document."""
    paths = table(spark, sf_dir, "lineitem").select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("path")).distinct()
    paths = paths.withColumn("numbers", F.transform(F.split("path", r"\."), lambda x: x.cast("long")))
    return seq.overall_rank(paths, F.get("numbers", 0), ["numbers"]).select("path", "rank")


@query("SELECT event_type, round(avg(value), 1) AS avg_ms, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS tokens, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY event_type")
def trace_stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean duration, tokens and errors of each stage."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.avg("value"), 1).alias("avg_ms"), F.sum(F.from_json("props", "k bigint")["k"]).alias("tokens"), F.count_if(F.col("event_type") == "error").alias("n_errors"))


@query("""WITH r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)
SELECT event_type, round(avg(CASE WHEN value > 0 THEN value END), 6) AS avg_ms, count(*) AS n, count(DISTINCT user_id) AS n_users FROM r GROUP BY event_type""")
def recent_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the last hundred events."""
    last = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return last.groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") > 0, F.col("value"))), 6).alias("avg_ms"), F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("""(SELECT 'slow' AS kind, event_id, value FROM events WHERE value > 30 ORDER BY value DESC, event_id LIMIT 3)
UNION ALL (SELECT 'error' AS kind, event_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 5)""")
def slow_topk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three slowest events over the threshold and the last five errors."""
    rows = table(spark, sf_dir, "events")
    slow = rows.where("value > 30").orderBy(F.desc("value"), "event_id").limit(3).select(F.lit("slow").alias("kind"), "event_id", "value")
    errors = rows.where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select(F.lit("error").alias("kind"), "event_id", "value")
    return slow.unionByName(errors)


_FIRST = """(SELECT user_id, v, first_pos, row_number() OVER (PARTITION BY user_id ORDER BY first_pos) AS rank FROM
(SELECT user_id, v, min(pos) AS first_pos FROM (SELECT user_id, floor(value)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) GROUP BY user_id, v))"""


def _first_occurrences(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", F.floor("value").alias("v"), place.alias("pos"))
    first = rows.groupBy("user_id", "v").agg(F.min("pos").alias("first_pos"))
    return seq.top(first, ["user_id"], ["first_pos"], k)


@query(f"SELECT user_id, v, rank FROM {_FIRST} WHERE rank <= 8")
def distinct_first8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight different values of a user, by their first place."""
    return _first_occurrences(spark, sf_dir, 8).select("user_id", "v", "rank")


@query(f"SELECT user_id, string_agg(v::VARCHAR, ',' ORDER BY rank) AS recommendations FROM {_FIRST} WHERE rank <= 10 GROUP BY user_id")
def recommendations_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different recommendations in order of their first place, ten at most."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))), lambda x: x["v"].cast("string"))
    return _first_occurrences(spark, sf_dir, 10).groupBy("user_id").agg(F.array_join(ordered, ",").alias("recommendations"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_minute,
count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM events""")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a user in the last minute and hour."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    trailing = lambda s: F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("m").rangeBetween(-s * 1_000_000, 0))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", micros.alias("m"))
    return rows.select("event_id", trailing(60).alias("in_minute"), trailing(3600).alias("in_hour"))


@query("""SELECT l_orderkey, count(*) AS n, max(l_linenumber - rn) = 0 AND min(l_linenumber - rn) = 0 AS continuous FROM
(SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem) GROUP BY l_orderkey""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the labels of a sequence follow one another from the first."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))).alias("gap"))
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), ((F.max("gap") == 0) & (F.min("gap") == 0)).alias("continuous"))


@query("""SELECT event_id, CASE WHEN v <= 60 THEN 4 WHEN v <= 120 THEN 3 WHEN v <= 180 THEN 2 WHEN v <= 240 THEN 1 ELSE 0 END::BIGINT AS score,
CASE WHEN v <= 120 THEN 'pass' WHEN v <= 240 THEN 'partial' ELSE 'fail' END AS verdict FROM (SELECT event_id, value * 4 AS v FROM events)""")
def latency_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for the time that a document took."""
    v = F.col("value") * 4
    score = F.when(v <= 60, 4).when(v <= 120, 3).when(v <= 180, 2).when(v <= 240, 1).otherwise(0).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", score.alias("score"))
    return rows.select("event_id", "score", F.when(F.col("score") >= 3, "pass").when(F.col("score") >= 1, "partial").otherwise("fail").alias("verdict"))


@query("""WITH o AS (SELECT l_orderkey, count(*) AS engineers, sum(l_quantity) AS km, count(DISTINCT l_suppkey) AS workers, count(*) FILTER (l_returnflag = 'R') AS supervisors FROM lineitem GROUP BY l_orderkey),
r AS (SELECT l_orderkey, engineers < greatest(1, ceil(km / 100)) AS no_engineers, supervisors < ceil(km / 30) AS no_supervisors,
CASE WHEN km / workers > 10 THEN 'high' WHEN km / workers < 3 THEN 'low' END AS patrol FROM o),
c AS (SELECT l_orderkey, no_engineers::BIGINT + coalesce(patrol = 'high', false)::BIGINT AS h, no_supervisors::BIGINT AS m, coalesce(patrol = 'low', false)::BIGINT AS l FROM r)
SELECT l_orderkey, h AS n_high, m AS n_medium, l AS n_low, CASE WHEN h + m + l = 0 THEN 'pass' WHEN h > 0 THEN 'fail' ELSE 'partial' END AS verdict,
CASE WHEN h + m + l = 0 THEN 14 WHEN h > 0 THEN 5 ELSE 10 END::BIGINT AS score FROM c""")
def staffing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staffing by length: engineers, supervisors and the load of a patrol worker."""
    facts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("engineers"), F.sum("l_quantity").alias("km"), F.count_distinct("l_suppkey").alias("workers"), F.count_if(F.col("l_returnflag") == "R").alias("supervisors"))
    load = F.col("km") / F.col("workers")
    high = (F.col("engineers") < F.greatest(F.lit(1), F.ceil(F.col("km") / 100))).cast("long") + (load > 10).cast("long")
    counts = facts.select("l_orderkey", high.alias("n_high"), (F.col("supervisors") < F.ceil(F.col("km") / 30)).cast("long").alias("n_medium"), (load < 3).cast("long").alias("n_low"))
    n, h = F.col("n_high") + F.col("n_medium") + F.col("n_low"), F.col("n_high") > 0
    verdict, score, _ = folds.ladder([(n == 0, ("pass", 14, 95)), (h, ("fail", 5, 80)), (F.lit(True), ("partial", 10, 75))])
    return counts.select("*", verdict, score)


#: Rows that a task joins.
TASK_ROWS = 1 << 20


@query("""SELECT o_orderkey, count(*) FILTER (l_shipdate < o_orderdate) AS n_inverted, count(DISTINCT year(l_shipdate)) > 1 AS year_mismatch FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def date_order_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates against their order, and more than one year."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    # tasks of about as many rows for any input: by their compressed bytes these narrow rows would be packed into a few
    n = max(1, -(-lines.count() // TASK_ROWS))
    joined = lines.repartition(n, "o_orderkey").join(orders.repartition(n, "o_orderkey"), "o_orderkey")
    year = F.year("l_shipdate")
    return joined.groupBy("o_orderkey").agg(
        F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("n_inverted"), F.coalesce(F.min(year) != F.max(year), F.lit(False)).alias("year_mismatch"))


@query("""SELECT l_orderkey, count(*) FILTER (NOT l_discount BETWEEN 0.02 AND 0.08) AS n_outside, CASE WHEN count(*) FILTER (NOT l_discount BETWEEN 0.02 AND 0.08) > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM lineitem GROUP BY l_orderkey""")
def range_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside their range."""
    outside = F.count_if(~F.col("l_discount").between(0.02, 0.08))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(outside.alias("n_outside"), F.when(outside > 0, "fail").otherwise("pass").alias("verdict"))


@query("SELECT time_bucket(INTERVAL 20 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by windows of twenty minutes; the batch twin of streaming.trace."""
    w = F.window("ts", "20 minutes")
    return table(spark, sf_dir, "events").groupBy(w["start"].alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM events) GROUP BY window_start""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by windows of an hour that begin every half hour."""
    w = F.window("ts", "60 minutes", "30 minutes")
    return table(spark, sf_dir, "events").groupBy(w["start"].alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS opens FROM events)) GROUP BY user_id, s""")
def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that half an hour without events ends."""
    w = F.session_window("ts", "30 minutes")
    return table(spark, sf_dir, "events").groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")
