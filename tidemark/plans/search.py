"""Search queries: benchmark items against documents, vectors against vectors."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import gram_index, retrieval, vectors, word_index
from tidemark.operators import search as s
from tidemark.operators.gram_index import GramIndex
from tidemark.queries import query
from tidemark.session import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))


_INDEXES: dict[tuple[str, str], str] = {}


def documents_index(spark: SparkSession, sf_dir: str) -> GramIndex:
    """The trigram index of `documents`: written by the first query of an application that needs it."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name in _INDEXES:
        try:
            return gram_index.reopened(spark, _INDEXES[name])
        except AnalysisException:  # the folder was cleared meanwhile
            pass
    index = gram_index.build(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    _INDEXES[name] = index.path
    return index


def documents_words(spark: SparkSession, sf_dir: str) -> word_index.WordIndex:
    """The word index of `documents`, written once in an application."""
    name = (spark.sparkContext.applicationId, f"{sf_dir} words")
    if name in _INDEXES:
        try:
            return word_index.reopened(spark, _INDEXES[name])
        except AnalysisException:
            pass
    index = word_index.build(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    _INDEXES[name] = index.path
    return index


_GRAMS = """g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substring(lower(text), i::INT, 3)))) AS gram FROM documents WHERE length(text) >= 3),
i AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substring(lower(text), i::INT, 3)))) AS gram FROM benchmark WHERE length(text) >= 3),
m AS (SELECT item_id, doc_id FROM i JOIN g USING (gram))"""


@query(f"""WITH {_GRAMS}, x AS (SELECT item_id, doc_id, count(*) AS overlap FROM m GROUP BY ALL), h AS (SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)))
SELECT x.item_id, x.doc_id, overlap, h.doc_id IS NOT NULL AS contained FROM x LEFT JOIN h ON x.item_id = h.item_id AND x.doc_id = h.doc_id""")
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that shares a trigram with an item, with their number, and whether it holds the whole item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return gram_index.shared_grams(docs, "doc_id", "text", _items(spark, sf_dir).withColumn("phrase", F.lower("phrase")), "item_id", "phrase")


@query(r"""WITH t AS (SELECT item_id, list_distinct(list_filter(string_split_regex(text, '\s+'), lambda w: length(w) >= 3 AND upper(w) NOT IN ('OR', 'AND', 'NOT'))) AS words FROM benchmark),
h AS (SELECT item_id, doc_id FROM t, documents d WHERE len(list_filter(words, lambda w: contains(lower(d.text), lower(w)))) > 0)
SELECT item_id, doc_id, false AS fallback, rank FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM h) WHERE rank <= 10""")
def substr_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten documents that hold any token of an item as a substring; items without hits are searched whole."""
    return retrieval.token_search(_items(spark, sf_dir), documents_index(spark, sf_dir), "item_id", "phrase", "doc_id", 10)


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents), st AS (SELECT count(*) AS n, avg(len(ws)) AS avg_len FROM d),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT item_id, tf.doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ws) / avg_len))), 6) AS score
FROM q JOIN df USING (term) JOIN tf USING (term) JOIN d ON d.doc_id = tf.doc_id, st GROUP BY ALL)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def token_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each item by BM25."""
    return word_index.topk(_items(spark, sf_dir), documents_words(spark, sf_dir), "item_id", "phrase", "doc_id", 10)


_PAIRS = """c AS (SELECT q.vec_id AS q_id, v.vec_id, v.label, q.label AS q_label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id"""
_BEST = """),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM c) WHERE rank <= 10),
same AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM c WHERE label = q_label) WHERE rank <= 10)"""
_COSINE = f"{_PAIRS} WHERE q.vec_id % 20 = 0{_BEST}"


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vector"))
    return s.dense_topk(queries, rows, "q_id", "q_vector", "vec_id", "embedding", k)


@query(f"WITH {_COSINE} SELECT q_id, vec_id, score, rank FROM dense WHERE rank <= 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every twentieth vector."""
    return _dense(spark, sf_dir, 5)


@query(f"WITH {_COSINE} SELECT q_id, vec_id, score, rank FROM dense WHERE rank <= 5")
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors by the index of cells, with every cell probed that may hold a nearer one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vector"))
    return vectors.index_topk(queries, vectors.build_index(rows, "vec_id", "embedding"), "q_id", "q_vector", "vec_id", 5, exact=True)


@query(f"""WITH {_PAIRS}{_BEST}, u AS (SELECT q_id, vec_id, 0 AS leg, rank FROM same UNION ALL SELECT q_id, vec_id, 1 AS leg, rank FROM dense),
f AS (SELECT q_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(leg * 1000 + rank) AS first FROM u GROUP BY ALL)
SELECT q_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, first, vec_id) AS rank FROM f) WHERE rank <= 5""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the same label fused with all neighbours, for every vector."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vector"), "label")
    legs = s.dense_legs(queries, rows, "q_id", "q_vector", "vec_id", "embedding", 10, "label")
    return s.fuse_legs(legs, "q_id", "vec_id", 5)


@query(f"""WITH {_COSINE} SELECT q_id, vec_id, rank FROM (SELECT *, count(*) FILTER (label = q_label) OVER (PARTITION BY q_id) AS n FROM dense) WHERE label = q_label OR n < 2""")
def fallback_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the query's label, or all where fewer than two are."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    ranked = _dense(spark, sf_dir, 10).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("q_id"), F.col("label").alias("q_label")), "q_id")
    return s.prefer_filtered(ranked, "q_id", F.col("label") == F.col("q_label")).select("q_id", "vec_id", "rank")


_PREFIX = 60


@query(f"""SELECT item_id, count(d.doc_id) AS n_docs, min(d.doc_id) AS first_doc, count(d.doc_id) > 0 AS found FROM (SELECT item_id, substring(text, 1, {_PREFIX}) AS phrase FROM benchmark) b
LEFT JOIN documents d ON contains(lower(d.text), lower(b.phrase)) GROUP BY item_id""")
def evidence_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an item's start (evidence is told by its start) is found in any document, and the first that has it."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, _PREFIX).alias("phrase"))
    found = s.contains_search(items, documents_index(spark, sf_dir), "item_id", "phrase", "doc_id")
    joined = items.select("item_id").join(found, "item_id", "left")
    return joined.groupBy("item_id").agg(F.count("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"), (F.count("doc_id") > 0).alias("found"))
