"""Queries over stored relations and contexts: scans, tasks, imports, budgets, fused legs, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import retrieval
from tidemark.operators.sequence import priority_budget, top
from tidemark.plans.documents import TAG_WORDS
from tidemark.plans.search import _COSINE, _dense
from tidemark.queries import query
from tidemark.session import table, written
from tidemark.sources import registry, store


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.col("text").contains(w)), F.lit(t)) for t, ws in TAG_WORDS.items()]))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", tags.alias("dimensions"))


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'password') OR contains(text, 'token')")
def dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that carry a dimension's tag."""
    return store.by_dimension(_tagged(spark, sf_dir), "secret").select("doc_id", "source")


@query("""SELECT doc_id, d.dimension, CASE WHEN d.dimension = 'all' OR contains(text, d.w1) OR contains(text, d.w2) THEN 1 ELSE 0 END::BIGINT AS n_rows, d.dimension = 'all' OR contains(text, d.w1) OR contains(text, d.w2) AS ready
FROM documents, (VALUES ('secret', 'password', 'token'), ('law', 'License', 'License'), ('all', '', '')) AS d(dimension, w1, w2)""")
def evaluator_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which evaluators see rows of a document; some see tagged rows only."""
    docs = _tagged(spark, sf_dir)
    dims = spark.createDataFrame([("secret",), ("law",), ("all",)], "dimension string")
    return retrieval.routed(docs, docs, dims, ["secret", "law"])


@query("SELECT doc_id, quality FROM labels WHERE quality = 0 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def labels_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the documents of a list, of one pipeline."""
    rows = table(spark, sf_dir, "labels").withColumn("pipeline", F.when(F.col("quality") == 0, "audit").otherwise("label"))
    return store.labels_of(rows, table(spark, sf_dir, "documents").where("lang = 'fr'"), "audit").select("doc_id", "quality")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM lineitem)
SELECT coalesce(l_orderkey, o_orderkey) AS task_id, coalesce(l_linestatus, o_orderstatus) AS status FROM orders FULL JOIN (SELECT * FROM c WHERE rn = 1) c ON l_orderkey = o_orderkey WHERE l_returnflag IS NULL OR l_returnflag <> 'R'""")
def task_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks after inserts, updates and deletions, the last change of each counting."""
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"))
    op = F.when(F.col("l_returnflag") == "R", "delete").otherwise("upsert")
    version = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linestatus").alias("status"), op.alias("op"), version.alias("version"))
    return store.task_changes(tasks, changes)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events")
def newest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each key, the newest first."""
    return store.newest_first(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "place")


@query("""WITH p AS (SELECT DISTINCT source FROM documents WHERE n_chars > 30000), c AS (SELECT source, count(*) FILTER (lang <> 'en') AS n FROM documents GROUP BY source)
SELECT source, CASE WHEN source IN (SELECT source FROM p) THEN -1 ELSE n END::BIGINT AS n FROM c""")
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows an import adds for each source; 0 for none, -1 for a source that is there."""
    docs = table(spark, sf_dir, "documents")
    return store.import_counts(docs.select("source").distinct(), docs.where("lang <> 'en'"), docs.where("n_chars > 30000"))


@query("""SELECT user_id, '["' || string_agg(DISTINCT event_type, '","' ORDER BY event_type) || '"]' AS types, count(DISTINCT event_type) AS n FROM events GROUP BY user_id""")
def row_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested column as JSON text for a flat store, and read back."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    flat = store.export_row(rows, ["types"])
    back = store.import_row(flat.withColumn("again", F.col("types")), {"again": "array<string>"})
    return back.select("user_id", "types", F.size("again").cast("long").alias("n"))


@query(r"SELECT page_id, regexp_full_match(url, '[\w\-.]+') AS url_ok, regexp_full_match(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '[\w\-.]+') AS id_ok FROM pages")
def chunk_id_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether identifiers have the format of chunk ids."""
    fits = lambda c: c.rlike(r"^[\w\-.]+$")
    return table(spark, sf_dir, "pages").select("page_id", fits(F.col("url")).alias("url_ok"), fits(F.regexp_replace("url", "[^A-Za-z0-9_-]+", "_")).alias("id_ok"))


@query("SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'system') AND trim(text) <> ''")
def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of some types, in any case, that are not blank."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.upper("role").alias("chunk_type"), F.col("text").alias("content"))
    return retrieval.typed_rows(rows, ["User", "system"]).select("conv_id", "turn")


@query("""SELECT conv_id, md5(string_agg(excerpt, chr(10) || '---' || chr(10) ORDER BY rn)) AS excerpt FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY rn) AS used, substring(text, 1, 600) AS excerpt FROM
(SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY (contains(text, 'the') OR contains(text, 'les')) DESC, turn) AS rn FROM conversations) WHERE rn <= 40) WHERE used <= 600 OR rn = 1 GROUP BY conv_id""")
def excerpt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excerpt rows of each conversation as one text."""
    rows = table(spark, sf_dir, "conversations")
    kept = priority_budget(rows, ["conv_id"], F.col("text").contains("the") | F.col("text").contains("les"), ["turn"], 40, 600, "text")
    return retrieval.excerpt_text(kept, ["conv_id"], "rn", "excerpt").select("conv_id", F.md5("excerpt").alias("excerpt"))


@query("""WITH c AS (SELECT conv_id AS doc_id, turn AS pos, role, text, role = 'system' AS sys, length(text) > 400 AS big FROM conversations),
e AS (SELECT *, 'S' AS dimension, sys AS hit FROM c UNION ALL SELECT *, 'L' AS dimension, big AS hit FROM c),
a AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id, dimension) AS any_hit FROM e), k AS (SELECT * FROM a WHERE hit OR NOT any_hit),
w AS (SELECT *, sum(length(text) / 1500.0::DOUBLE) OVER (PARTITION BY doc_id, dimension ORDER BY pos) AS used FROM k)
SELECT doc_id, dimension, md5(string_agg('### ' || role || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY pos)) AS text FROM w WHERE used <= 1 GROUP BY doc_id, dimension""")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each document and dimension: its tagged rows or all, within a budget, as one text."""
    dims = F.array_compact(F.array(F.when(F.col("role") == "system", "S"), F.when(F.length("text") > 400, "L")))
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("role").alias("title"), F.col("text").alias("content"), dims.alias("dimensions"))
    kept = retrieval.context_rows(rows, spark.createDataFrame([("S",), ("L",)], "dimension string"), 1500)
    return retrieval.context_text(kept).select("doc_id", "dimension", F.md5("text").alias("text"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type = 'error') WHERE rn <= 3")
def limit_by_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by the order of insertion, which an unordered limit returns."""
    return top(table(spark, sf_dir, "events").where("event_type = 'error'"), ["user_id"], ["event_id"], 3).select("user_id", "event_id")


@query("""SELECT user_id, array_to_string(list_concat(['view'], CASE WHEN bool_or(event_type = 'error') AND bool_or(event_type = 'click') THEN ['audit'] ELSE [] END), ',') AS required FROM events GROUP BY user_id""")
def extra_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements with those that conditions on the data add."""
    has = lambda t: F.bool_or(F.col("event_type") == t)
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg((has("error") & has("click")).alias("more"))
    extra = F.array_compact(F.array(F.when(F.col("more"), "audit")))
    return rows.select("user_id", F.array_join(F.array_union(F.array(F.lit("view")), extra), ",").alias("required"))


@query(f"""WITH {_COSINE}, lex AS (SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY vec_id) AS rank FROM dense WHERE rank <= 8 AND vec_id < q_id),
u AS (SELECT q_id, vec_id, 0 AS leg, rank FROM lex UNION ALL SELECT q_id, vec_id, 1 AS leg, rank FROM dense),
f AS (SELECT q_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(leg * 1000 + rank) AS first, count(*) AS c FROM u GROUP BY ALL), n AS (SELECT q_id FROM lex GROUP BY q_id),
x AS (SELECT q_id, vec_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, first, vec_id) AS rank FROM f WHERE q_id IN (SELECT q_id FROM n))
SELECT q_id, vec_id, rank FROM x WHERE rank <= 5 UNION ALL SELECT q_id, vec_id, rank FROM dense WHERE rank <= 5 AND q_id NOT IN (SELECT q_id FROM n)""")
def hybrid_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two legs fused; a query that only one leg answers gets that leg as it is."""
    dense = written(spark, _dense(spark, sf_dir, 10), "dense")  # both legs read it
    lexical = top(dense.where("rank <= 8 and vec_id < q_id").select("q_id", "vec_id"), ["q_id"], ["vec_id"], 1 << 30)
    return retrieval.snippets(dense, lexical, "q_id", "vec_id").select("q_id", "vec_id", "rank")


@query("""SELECT doc_id AS path, part::BIGINT AS part, (part * w + 1)::BIGINT AS first_page, least((part + 1) * w, n)::BIGINT AS last_page FROM
(SELECT doc_id, n_chars // 100 AS n, ceil(n_chars // 100 / 4.0)::BIGINT AS w, unnest(range(4)) AS part FROM documents WHERE n_chars // 100 > 0) WHERE part * w + 1 <= least((part + 1) * w, n)""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each file in equal ranges, to be parsed apart (a hundred characters stand for a page)."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.floor(F.col("n_chars") / 100).alias("n_pages"))
    return registry.page_ranges(files, 4).select("path", *[F.col(c).cast("long").alias(c) for c in ("part", "first_page", "last_page")])


@query("SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS level, l_returnflag AS heading, min(l_suppkey) AS page FROM lineitem GROUP BY ALL")
def merged_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that several ranges report, each once with its lowest page."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("level"), F.col("l_returnflag").alias("heading"), F.col("l_suppkey").alias("page"))
    return registry.merged_toc(rows)


@query("SELECT c_nationkey, max(y)::BIGINT AS latest_year FROM (SELECT c_nationkey, 1990 + c_custkey % 40 AS y FROM customer) GROUP BY c_nationkey")
def latest_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest year in the names of what was found."""
    name = F.concat(F.lit("GB 1234-"), (1990 + F.col("c_custkey") % 40).cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", name.alias("name"))
    return retrieval.latest_year_in(rows, ["c_nationkey"], "name").select("c_nationkey", F.col("latest_year").cast("long").alias("latest_year"))


@query("""WITH t AS (SELECT conv_id AS doc_id, turn AS pos, CASE WHEN turn % 3 = 1 THEN '附录A 表' ELSE role END AS title FROM conversations)
SELECT doc_id, min(pos) AS pos FROM t WHERE contains(title, '附录A') GROUP BY doc_id""")
def appendix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first row of an appendix, by its label or title."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(F.col("turn") % 3 == 1, "附录A 表").otherwise(F.col("role")).alias("title"), F.col("text").alias("content"), F.lit(None).cast("string").alias("appendix_id"))
    return retrieval.appendix(rows, "A").select("doc_id", "pos")


@query("SELECT item_id, d.dimension, d.q AS query FROM benchmark, (VALUES ('E1_staffing', '员工 工程师 巡线 区段'), ('L2_standards', '标准 GB QSY TSG'), ('other', NULL)) AS d(dimension, q) WHERE d.q IS NOT NULL UNION ALL SELECT item_id, 'other', substring(text, 1, 200) FROM benchmark")
def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retrieval queries of all documents and dimensions as one relation."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    dims = spark.createDataFrame([("E1_staffing",), ("L2_standards",), ("other",)], "dimension string")
    return retrieval.prewarmed(dims, items, retrieval.static_query(F.col("dimension"), F.col("text"))).select(F.col("doc_id").alias("item_id"), "dimension", "query")


@query(r"""WITH t AS (SELECT item_id, list_distinct(list_filter(string_split_regex(text, '\s+'), lambda w: length(w) >= 3 AND upper(w) NOT IN ('OR', 'AND', 'NOT'))) AS words FROM benchmark),
h AS (SELECT item_id, doc_id FROM t, documents d WHERE d.source IN ('src' || (item_id % 20), 'src' || ((item_id + 1) % 20), 'src' || ((item_id + 2) % 20)) AND len(list_filter(words, lambda w: contains(lower(d.text || chr(10) || lang), lower(w)))) > 0)
SELECT item_id, doc_id AS clause_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM h) WHERE rank <= 3""")
def clause_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses by any token of a query, within the standards that the query may cite."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clause_id"), F.col("source").alias("standard_name"), F.lit("").alias("title"), F.col("text").alias("content"), F.array(F.col("lang")).alias("tags"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    allowed = items.select("item_id", F.explode(F.array(*[F.concat(F.lit("src"), ((F.col("item_id") + i) % 20).cast("string")) for i in range(3)])).alias("standard_name"))
    return retrieval.clause_search(items, retrieval.clause_index(docs), "item_id", "query", 3, allowed).select("item_id", "clause_id", "rank")

