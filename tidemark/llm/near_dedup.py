"""MinHash near-dedup by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles: term frequency times the mean inverse document
frequency of the shingle's words. (The words' and not the shingle's own frequency: the shingles of a
group of thousands of copies would lose their weight just where it is needed.) Word frequencies are
counted over all documents into `IDF_BITS` hash buckets, a table of fixed size.

Equal texts are one node. Each node gets `BANDS` * `ROWS` samples by improved consistent weighted
sampling (Ioffe, 2010): two sets agree on a sample with the probability of their weighted Jaccard
similarity. Nodes that agree on a whole band meet in a bucket; buckets of equal membership are handled
once. In a bucket of up to `BLOCK` texts all are compared exactly. In a larger one all are compared with
one leader: those similar to it are connected by it, and since the distance (one less the similarity) is a
metric, the others need comparing only with texts of about their own distance from the leader, in blocks
of at most `BLOCK` against `BLOCK`. No link between texts that meet is lost, and a block yields just enough
verified links to keep what it connects connected. Components of the links are the classes.

Null and empty texts are equal to each other and to nothing else. A text of one to four words is one
shingle. Rows repeating id and text are one document. The class id is the smallest id of the class (null
only if it has no other). Only the id and text columns are read; an empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import mix, scratch, slices, window_hashes, windows_of_rows, word_bounds, word_hashes
from tidemark.llm._components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
IDF_BITS = 18
BLOCK = 256

_TABLE = 1 << 16


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the middles of _TABLE equal steps, by Newton's method."""
    p = (np.arange(_TABLE) + 0.5) / _TABLE
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), 1e-6)
    return x


_Q = _gamma_quantiles()
_R, _R_INV, _LOG_C = _Q.astype(np.float32), (1 / _Q).astype(np.float32), np.log(_Q).astype(np.float32)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def weighted_sets(texts: pa.Array, idf: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, row of each shingle, hash, weight), distinct and sorted by row and hash."""
    shift = np.uint64(64 - IDF_BITS)
    for first, last, raw, row_at in slices(texts):
        starts, ends, first_word = word_bounds(raw, row_at)
        words = word_hashes(raw, starts, ends)
        mass = np.zeros(len(words) + 1)
        np.cumsum(idf[(words >> shift).astype(np.int64)], out=mass[1:])
        rows, hashes, weights = [], [], []
        count = np.diff(first_word)
        for size in range(1, WORDS + 1):
            at, row = windows_of_rows(first_word, size)
            if size < WORDS:  # only the rows that have no more words
                short = count[row] == size
                at, row = at[short], row[short]
            if len(at):
                rows.append(row)
                hashes.append(window_hashes(words, size)[at])
                weights.append((mass[at + size] - mass[at]) / size)
        if not rows:
            yield first, last, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.float32)
            continue
        row, value, weight = np.concatenate(rows), np.concatenate(hashes), np.concatenate(weights)
        order = np.lexsort((value, row))
        row, value, weight = row[order], value[order], weight[order]
        begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])]))
        times = np.diff(begin, append=len(row))
        yield first, last, row[begin], value[begin], (weight[begin] * times).astype(np.float32)


def signatures(n_rows: int, row: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(n_rows, BANDS) band keys by consistent weighted sampling; rows without shingles have zeros."""
    keys = np.zeros((n_rows, BANDS), np.uint64)
    if not len(row):
        return keys
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    owner = row[begin]
    length = np.diff(begin, append=len(row))
    log_s = np.log(weight).astype(np.float32)
    low = np.uint64(_TABLE - 1)
    for k, seed in enumerate(_SEEDS):
        x = mix(value ^ seed)
        ri = (x & low).astype(np.int64)
        beta = ((x >> np.uint64(16)) & low).astype(np.float32) / np.float32(_TABLE)
        r = _R[ri]
        t = np.floor(log_s * _R_INV[ri] + beta)
        log_a = _LOG_C[((x >> np.uint64(32)) & low).astype(np.int64)] - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, begin)
        at = np.flatnonzero(log_a == np.repeat(least, length))
        at = at[np.diff(np.searchsorted(begin, at, "right"), prepend=0) > 0]  # the first of each row
        sample = mix(value[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        band = k // ROWS
        keys[owner, band] = mix(keys[owner, band] * np.uint64(31) + sample + np.uint64(band + 1))
    return keys


def jaccard_links(nodes: list[bytes], sets: list[tuple[np.ndarray, np.ndarray]], n_left: int | None, threshold: float) -> list[tuple[bytes, bytes]]:
    """Verified links that connect what the similarities of these sets connect.

    n_left: only pairs of one of the first n_left with one of the others, else all pairs.
    """
    n = len(nodes)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    total = np.array([w.sum(dtype=np.float64) for _, w in sets])
    owner = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    value = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    distinct, column = np.unique(value, return_inverse=True)
    by_column = np.argsort(column, kind="stable")
    begin = np.searchsorted(column[by_column], np.arange(len(distinct) + 1))
    links = []
    for i in range(n if n_left is None else n_left):
        others = np.zeros(n)
        mine = slice(*np.searchsorted(owner, [i, i + 1]))
        # all entries of the columns that i has, gathered at once
        cols, w = column[mine], weight[mine]
        size = begin[cols + 1] - begin[cols]
        start = np.cumsum(size) - size
        entry = by_column[np.arange(size.sum()) - np.repeat(start, size) + np.repeat(begin[cols], size)]
        np.add.at(others, owner[entry], np.minimum(weight[entry], np.repeat(w, size)))
        similar = others / np.maximum(total[i] + total - others, 1e-30)
        lo = i + 1 if n_left is None else n_left
        for j in np.flatnonzero(similar[lo:] >= threshold) + lo:
            a, b = find(i), find(int(j))
            if a != b:
                parent[a] = b
                links.append((nodes[i], nodes[int(j)]))
    return links


def weighted_jaccard(h: np.ndarray, w: np.ndarray, other_h: np.ndarray, other_w: np.ndarray) -> float:
    """The weighted Jaccard similarity of two sets with sorted hashes."""
    _, a, b = np.intersect1d(h, other_h, assume_unique=True, return_indices=True)
    shared = np.minimum(w[a], other_w[b]).sum(dtype=np.float64)
    return float(shared / max(w.sum(dtype=np.float64) + other_w.sum(dtype=np.float64) - shared, 1e-30))


def _idf(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies by hash bucket of the word, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(1 << IDF_BITS, np.int64), 0
        for batch in batches:
            for first, last, raw, row_at in slices(batch.column(0)):
                starts, ends, first_word = word_bounds(raw, row_at)
                bucket = (word_hashes(raw, starts, ends) >> np.uint64(64 - IDF_BITS)).astype(np.int64)
                row = np.repeat(np.arange(last - first), np.diff(first_word))
                seen += np.bincount(np.unique(row << IDF_BITS | bucket) & (1 << IDF_BITS) - 1, minlength=1 << IDF_BITS)
                rows += last - first
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], ["bucket", "n"])

    # one row for each bucket at most, so this is of fixed size
    counts = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << IDF_BITS)
    words = counts[counts.bucket >= 0]
    table[words.bucket] = words.n
    total = counts[counts.bucket < 0].n.sum()
    return np.log((1.0 + total) / (1.0 + table)) + 1.0


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, digest, root): each document with the MD5 of its text and that of its class's root text."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    idf = spark.sparkContext.broadcast(_idf(docs))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, row, value, weight in weighted_sets(batch.column(1), idf.value):
                keys = signatures(last - first, row, value, weight)
                bare = np.bincount(row, minlength=last - first) == 0
                digests = [hashlib.md5(t.as_buffer()).digest() for t in batch.column(1).slice(first, last - first)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
                lists = pa.array([None if b else x for b, x in zip(bare, lists.to_pylist(), strict=True)], pa.list_(pa.int64())) if bare.any() else lists
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(digests, pa.binary()), lists], ["id", "digest", "bands"])

    signed = scratch(spark, docs.mapInArrow(sign, f"id {id_type}, digest binary, bands array<long>"), "near-signed")
    nodes = signed.groupBy("digest").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    members = scratch(spark, nodes.select("digest", "id", F.posexplode("bands").alias("band", "key")), "near-members")
    buckets = members.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64(F.lit(5), "digest")).alias("y"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    # buckets of one membership (same size and ends, same 128 bits of a hash of the set) are handled once
    chosen = buckets.where("n > 1").groupBy("n", "x", "y", "low", "high").agg(F.min(F.struct("band", "key")).alias("b")).select("n", "low", "b.band", "b.key")
    chosen = scratch(spark, chosen, "near-buckets")
    met = scratch(spark, members.join(chosen, ["band", "key"]).select("band", "key", "n", "low", "digest", "id"), "near-met")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, row, value, weight in weighted_sets(batch.column(0), idf.value):
                begin = np.searchsorted(row, np.arange(last - first + 1))
                texts = batch.column(0).slice(first, last - first)
                part = list(zip(begin[:-1], begin[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.md5(t.as_buffer()).digest() for t in texts], pa.binary()),
                     pa.array([value[a:b].tobytes() for a, b in part], pa.binary()), pa.array([weight[a:b].tobytes() for a, b in part], pa.binary())],
                    ["digest", "hashes", "weights"])

    wanted = met.select(F.col("id").alias("_id")).distinct()
    texts = docs.join(wanted, docs["id"].eqNullSafe(wanted["_id"]), "left_semi").select("text")
    each = texts.groupBy(F.md5("text").alias("k")).agg(F.first("text").alias("text")).select("text")  # repeats of a text go once
    weighted = scratch(spark, each.mapInArrow(sets, "digest binary, hashes binary, weights binary"), "near-sets")

    def to_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6, 10)]
            near = [weighted_jaccard(*(np.frombuffer(x, t) for x, t in zip(row, (np.uint64, np.float32, np.uint64, np.float32), strict=True))) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(6)], pa.array(near, pa.float64())], ["band", "key", "n", "low", "digest", "id", "near"])

    # A bucket of more than BLOCK nodes: all are compared with its first one. Those within reach of it are
    # connected by it; the distance is a metric, so that a node farther off can only be similar to nodes of
    # its own or of the neighbouring rings around the leader.
    columns = ["band", "key", "n", "low", "digest", "id"]
    large = met.where(F.col("n") > BLOCK)
    leaders = weighted.select(F.col("digest").alias("low"), F.col("hashes").alias("lh"), F.col("weights").alias("lw"))
    measured = large.join(weighted, "digest").join(leaders, "low").select(*columns, "hashes", "weights", "lh", "lw")
    ddl = f"band int, key long, n long, low binary, digest binary, id {id_type}, near double"
    measured = scratch(spark, measured.mapInArrow(to_leader, ddl), "near-leaders")
    led = measured.where((F.col("near") >= similarity) & (F.col("digest") != F.col("low"))).select(F.col("low").alias("a"), F.col("digest").alias("b"))
    reach = (1 - similarity) * 1.0001  # a little wider, for rounding
    ring = F.when(F.col("near") >= similarity, 0).otherwise(F.greatest(F.lit(1), F.floor((1 - F.col("near")) / reach))).cast("int")
    ringed = measured.select("band", "key", "digest", ring.alias("ring"))
    # ring 0 is compared with ring 1 only, every other ring with itself and the next one
    outer = ringed.where("ring > 0").groupBy("band", "key", "ring").agg(F.count(F.lit(1)).alias("size"))
    sizes = ringed.groupBy("band", "key", "ring").agg(F.count(F.lit(1)).alias("size"))
    own = outer.where("size > 1").select("band", "key", F.col("ring").alias("r"), F.col("ring").alias("s"), F.col("size").alias("m"), F.col("size").alias("o"))
    beside = outer.select("band", "key", (F.col("ring") - 1).alias("r"), F.col("ring").alias("s"), F.col("size").alias("o")).join(
        sizes.select("band", "key", F.col("ring").alias("r"), F.col("size").alias("m")), ["band", "key", "r"])
    small = met.where(F.col("n") <= BLOCK).select("band", "key", "digest", F.lit(0).alias("ring"))
    whole = small.select("band", "key").distinct().select("band", "key", F.lit(0).alias("r"), F.lit(0).alias("s"), F.lit(1).cast("long").alias("m"), F.lit(1).cast("long").alias("o"))
    tasks = scratch(spark, whole.unionByName(own).unionByName(beside.select("band", "key", "r", "s", "m", "o")), "near-tasks")
    # both sides of a task are dealt into parts of at most about BLOCK, and each pair of parts is a block
    nodes_ = scratch(spark, small.unionByName(ringed), "near-ringed")
    part = lambda size: F.pmod(F.xxhash64("digest"), F.ceil(F.col(size) / BLOCK)).cast("int")
    others = lambda size: F.explode(F.sequence(F.lit(0), F.ceil(F.col(size) / BLOCK).cast("int") - 1))
    left = tasks.join(nodes_.withColumnRenamed("ring", "r"), ["band", "key", "r"])
    right = tasks.where("r <> s").join(nodes_.withColumnRenamed("ring", "s"), ["band", "key", "s"])
    inner = left.where("r = s").select("band", "key", "r", "s", part("m").alias("p"), others("m").alias("q"), "digest")
    inner = inner.select("band", "key", "r", "s", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") <= F.col("q")).alias("first"), "digest")
    across = left.where("r <> s").select("band", "key", "r", "s", part("m").alias("i"), others("o").alias("j"), F.lit(True).alias("first"), "digest").unionByName(
        right.select("band", "key", "r", "s", others("m").alias("i"), part("o").alias("j"), F.lit(False).alias("first"), "digest"))
    blocks = inner.unionByName(across).join(weighted, "digest")

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        r, s, i, j = (key[x].as_py() for x in range(2, 6))
        rows = {x["digest"]: x for x in table.to_pylist()}
        ordered = sorted(rows.values(), key=lambda x: (not x["first"], x["digest"]))
        n_left = None if (r, i) == (s, j) else sum(x["first"] for x in ordered)
        found = jaccard_links(
            [x["digest"] for x in ordered],
            [(np.frombuffer(x["hashes"], np.uint64), np.frombuffer(x["weights"], np.float32)) for x in ordered], n_left, similarity)
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})

    links = blocks.groupBy("band", "key", "r", "s", "i", "j").applyInArrow(verify, "a binary, b binary").unionByName(led)
    roots = components(links)
    joined = signed.select("id", "digest").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    return joined.select("id", "digest", F.coalesce("root", "digest").alias("root"))


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size) of every row; class_size counts rows."""
    found = scratch(df.sparkSession, classes(df, id_col, text_col, similarity), "near-classes")
    size = found.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    size = scratch(df.sparkSession, size, "near-sizes")
    return found.join(size, "root").select(F.col("id").alias("doc_id"), "class_id", "class_size")


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df whose document is the one of its class with the smallest id (then text hash)."""
    found = classes(df, id_col, text_col, similarity)
    kept = scratch(df.sparkSession, found.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("k")).select("k.id", "k.digest"), "near-kept")
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"), digest.alias("_digest"))
    return rows.join(kept, rows["_id"].eqNullSafe(kept["id"]) & (rows["_digest"] == kept["digest"]), "left_semi").select("_row.*")


def op4_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every row of `documents`."""
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
