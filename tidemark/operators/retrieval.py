"""Retrieval over stored clauses, skills and chunks, and the context that a dimension gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.lexicons import CONTEXT_BUDGETS, SEARCH_WORDS
from tidemark.operators import gram_index
from tidemark.operators.gram_index import GramIndex
from tidemark.operators.search import fuse, tokens
from tidemark.operators.sequence import top, within_budget
from tidemark.session import small, written

DEFAULT_BUDGET = (2500, 2000)


def word_tokens(text: Column) -> Column:
    """Words of two characters and more, and the pairs of neighbours in runs of Chinese characters, each once."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9\p{L}&&[^一-鿿]]+"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(r"[一-鿿]+"), F.lit(0))
    pairs = F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) > 1), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) > 1), pairs))


def token_search(
    queries: DataFrame, index: GramIndex, q: str, query: str, key: str, k: int, least: int = 3, most: int | None = None,
    allowed: DataFrame | None = None, first_token: bool = False, words: Column | None = None,
) -> DataFrame:
    """(q, key, rank, fallback): the first k documents by key that hold any of a query's tokens, in any case.

    A query whose tokens have no hit is searched again by its whole text, or by its first token (`first_token`),
    of any length. `allowed` (q, scope) restricts a query to documents of some scopes, before anything is counted.
    `words` replaces the tokens of the query.
    """
    found = tokens(F.col(query), least) if words is None else words
    phrases = queries.select(q, F.explode(F.slice(found, 1, most) if most else found).alias("_w")).select(q, F.lower("_w").alias("phrase"))
    spark = queries.sparkSession

    def search(wanted: DataFrame) -> DataFrame:
        if allowed is None:
            # one search for each different phrase, whatever the number of its queries
            hits = gram_index.find(index, wanted.select("phrase"), k)
            return wanted.join(hits, "phrase").select(q, "key").distinct()
        return gram_index.find(index, wanted, k, (q,), allowed).select(q, "key").distinct()

    hits = written(spark, search(phrases), "token-hits")
    whole = F.regexp_extract(query, r"\S+", 0) if first_token else F.col(query)
    rest = queries.select(q, F.lower(whole).alias("phrase")).join(hits.select(q).distinct(), q, "left_anti")
    every = hits.withColumn("fallback", F.lit(False))
    if not rest.isEmpty():
        every = every.unionByName(search(rest).withColumn("fallback", F.lit(True)))
    return top(every, [q], ["key"], k).select(q, F.col("key").alias(key), "rank", "fallback")


def clause_index(clauses: DataFrame) -> GramIndex:
    """The index of clauses over title, content and tags, by standard."""
    text = F.concat_ws("\n", "title", "content", F.array_join("tags", " "))
    return gram_index.build(clauses.withColumn("_t", text), "clause_id", "_t", "standard_name")


def clause_search(queries: DataFrame, index: GramIndex, q: str, query: str, k: int = 3, allowed: DataFrame | None = None) -> DataFrame:
    """(q, clause_id, rank, fallback): clauses by any token over title, content and tags, else by the query's first token.

    `allowed` (q, standard_name) restricts a query to some standards, as a dimension does; a query that no
    allowed clause answers falls back, whatever others hold.
    """
    scope = None if allowed is None else allowed.withColumnRenamed("standard_name", "scope")
    return token_search(queries, index, q, query, "clause_id", k, allowed=scope, first_token=True)


def skill_search(queries: DataFrame, skills: DataFrame, q: str, query: str, k: int = 3, dimension: str | None = None) -> DataFrame:
    """(q, skill_id, rank, fallback): skills that hold any of a query's first eight tokens of two characters, most used first.

    Tokens are found as substrings, in any case; a query without hits is searched whole in pattern and solution.
    """
    rows = skills if dimension is None else skills.where(F.col("dimension") == dimension)
    text = F.lower(F.concat_ws("\n", "name", "pattern", "solution", *([F.array_join("tags", " ")] if "tags" in skills.columns else [])))
    spark = queries.sparkSession
    index = gram_index.build(rows.withColumn("_t", text), "skill_id", "_t")
    found = F.filter(F.split(F.trim(query), r"\s+"), lambda w: F.length(w) >= 2)
    whole = F.filter(F.array(F.trim(query)), lambda w: w != "")
    phrases = queries.select(q, F.explode(F.slice(F.when(F.size(found) > 0, found).otherwise(whole), 1, 8)).alias("_w")).select(q, F.lower("_w").alias("phrase"))
    hits = phrases.join(gram_index.find(index, phrases.select("phrase")), "phrase").select(q, F.col("key").alias("skill_id")).distinct()
    hits = written(spark, hits.withColumn("fallback", F.lit(False)), "skill-hits")
    rest = queries.select(q, F.lower(query).alias("phrase")).join(hits.select(q).distinct(), q, "left_anti")
    again = gram_index.build(rows.withColumn("_t", F.concat_ws("\n", "pattern", "solution")), "skill_id", "_t")
    more = rest.join(gram_index.find(again, rest.select("phrase")), "phrase").select(q, F.col("key").alias("skill_id"), F.lit(True).alias("fallback"))
    used = hits.unionByName(more).join(rows.select("skill_id", "used_count"), "skill_id")
    return top(used, [q], [F.desc("used_count"), "skill_id"], k).select(q, "skill_id", "rank", "fallback")


def snippets(dense: DataFrame | None, lexical: DataFrame | None, q: str, key: str, k: int = 5) -> DataFrame:
    """(q, key, score, rank) of one or two legs (q, key, rank).

    A query that only one leg answers keeps that leg's order, because the fused score then falls with its rank.
    """
    legs = [leg for leg in (lexical, dense) if leg is not None]
    if not legs:
        raise ValueError("no leg to search")
    return fuse(legs, q, key, k)


def hashed_vector(text: Column, size: int = 64) -> Column:
    """A unit vector of a text's hashed words and word pairs: the embedding where no model is given."""
    words = F.split(F.lower(F.trim(text)), r"\s+")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    grams = F.filter(F.concat(words, pairs), lambda g: g.isNotNull() & (g != ""))
    cells = F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(cells, lambda c: c == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def prewarmed(dims: DataFrame, docs: DataFrame, query: Column) -> DataFrame:
    """(doc_id, dimension, query): all retrieval queries of a run as one relation, so that one plan answers them."""
    return docs.join(small(dims)).select("doc_id", "dimension", query.alias("query"))


def static_query(dimension: Column, fallback: Column) -> Column:
    """A dimension's search words, or the first characters of what it is about."""
    pairs = F.create_map(*[F.lit(x) for d, words in SEARCH_WORDS.items() for x in (d, " ".join(words))])
    return F.coalesce(F.try_element_at(pairs, dimension), F.substring(fallback, 1, 200))


def budgets() -> Column:
    """A map from dimension to its (chunks, standards) characters."""
    return F.create_map(*[x for d, (c, s) in CONTEXT_BUDGETS.items() for x in (F.lit(d), F.struct(F.lit(c).alias("chunks"), F.lit(s).alias("standards")))])


def context_rows(chunks: DataFrame, dims: DataFrame, budget: int | None = None) -> DataFrame:
    """The rows of each document and dimension: those with its tag, or all where none has it, within the budget.

    chunks: doc_id, pos, content, dimensions; dims: dimension. The budget is twice the dimension's own, and
    nothing follows the first row that does not fit.
    """
    every = chunks.join(small(dims)).withColumn("_hit", F.coalesce(F.array_contains("dimensions", F.col("dimension")), F.lit(False)))
    some = every.groupBy("doc_id", "dimension").agg(F.bool_or("_hit").alias("_any"))
    rows = every.join(some, ["doc_id", "dimension"]).where(F.col("_hit") | ~F.col("_any"))
    limit = F.lit(budget) if budget is not None else F.coalesce(F.try_element_at(budgets(), F.col("dimension"))["chunks"], F.lit(DEFAULT_BUDGET[0])) * 2
    # costs are scaled to a budget of one, as budgets differ by dimension
    share = F.length("content") / limit
    return within_budget(rows.drop("_hit", "_any"), ["doc_id", "dimension"], ["pos"], share, 1)


def context_text(rows: DataFrame) -> DataFrame:
    """(doc_id, dimension, text): the rows' titles and contents as one text."""
    piece = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("### "), "title", F.lit("\n"), "content")).otherwise(F.col("content"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("p")))), lambda x: x["p"])
    return rows.groupBy("doc_id", "dimension").agg(F.array_join(parts, "\n---\n").alias("text"))


def snippet_text(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, text): clauses as prompt text, `[name clause] title: content`; parts that are missing are left out."""
    head = F.concat(F.lit("["), F.concat_ws(" ", F.col("standard_name"), F.nullif("clause_num", F.lit(""))), F.lit("] "))
    line = F.concat(head, F.concat_ws(": ", F.nullif("title", F.lit("")), F.col("content")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def appendix(chunks: DataFrame, label: str) -> DataFrame:
    """(doc_id, pos, title, content): each document's first row of an appendix, by its label or its title."""
    hit = (F.coalesce("appendix_id", F.lit("")) == label) | F.coalesce("title", F.lit("")).contains(f"附录{label}")
    return top(chunks.where(hit), ["doc_id"], ["pos"], 1, "_r").select("doc_id", "pos", "title", "content")


def latest_year_in(names: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by, latest_year): the largest year that the names of the clauses found carry."""
    years = F.transform(F.regexp_extract_all(name, F.lit(r"((?:19|20)[0-9]{2})"), F.lit(1)), lambda y: y.cast("int"))
    return names.groupBy(*by).agg(F.max(F.array_max(years)).alias("latest_year"))


def typed_rows(chunks: DataFrame, types: list[str]) -> DataFrame:
    """All rows of the types, in any case, that are not blank."""
    return chunks.where(F.lower("chunk_type").isin(*[t.lower() for t in types]) & (F.trim("content") != ""))


def excerpt_text(rows: DataFrame, by: list[str], order: str, text: str, joiner: str = "\n---\n") -> DataFrame:
    """(by, excerpt): the rows of a key as one text in order."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), joiner).alias("excerpt"))


def routed(chunks: DataFrame, docs: DataFrame, dims: DataFrame, tagged_only: list[str]) -> DataFrame:
    """(doc_id, dimension, n_rows, ready): the rows that each evaluator sees.

    Dimensions of `tagged_only` see rows with their tag; a document without any is not ready for them.
    """
    rows = docs.select("doc_id").join(small(dims.select("dimension")))
    seen = chunks.join(small(dims.select("dimension"))).where(~F.col("dimension").isin(*tagged_only) | F.coalesce(F.array_contains("dimensions", F.col("dimension")), F.lit(False)))
    counted = seen.groupBy("doc_id", "dimension").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(counted, ["doc_id", "dimension"], "left").na.fill(0, ["n_rows"]).withColumn("ready", F.col("n_rows") > 0)


def matched_chunks(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Findings with the chunk that they name, or else the first of their document that holds their evidence."""
    by_id = chunks.select("doc_id", "chunk_id", F.col("pos").alias("_pos"))
    named = findings.join(by_id, ["doc_id", "chunk_id"], "left")
    texts = chunks.select("doc_id", F.col("chunk_id").alias("_id"), F.col("pos").alias("_at"), "content")
    loose = named.where("_pos is null").select("doc_id", "finding_id", "evidence").join(texts, "doc_id").where(F.col("content").contains(F.substring("evidence", 1, 200)) & (F.col("evidence") != ""))
    first = loose.groupBy("doc_id", "finding_id").agg(F.min(F.struct("_at", "_id")).alias("_f"))
    rows = named.join(first, ["doc_id", "finding_id"], "left")
    return rows.withColumns({"chunk_id": F.coalesce(F.when(F.col("_pos").isNotNull(), F.col("chunk_id")), "_f._id"), "pos": F.coalesce("_pos", "_f._at")}).drop("_pos", "_f")
