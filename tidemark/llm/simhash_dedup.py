"""SimHash near-duplicates by an inverted index of byte positions with count filtering.

A fingerprint of 64 bits is eight bytes. Two fingerprints that differ in at most two bits differ in at most
two bytes, so they share the bytes of at least six positions: the guaranteed minimum of the count filter. The
index lists, for every choice of two of the four aligned byte pairs, the fingerprints by the four bytes that
stand there; two differing bytes spoil at most two byte pairs, so each link meets in at least one list. In a
list the shared positional bytes of pairs are tallied, pairs with six or more are verified by their bits, and
of the links found only a spanning forest leaves the task, so that no list yields its square in rows. A list
of more than `LIST_LIMIT` fingerprints is dealt anew by two more of its other four byte positions (two links'
ends share at least two of these), which leaves 65,536 fingerprints to a list at most; none is cut or dropped.

Defined results: null and empty texts and texts of white space alone have fingerprint zero, which links like
any other. Copies share one fingerprint and are one entry of the index, however many they are. A null id keeps
its row; components are named by their smallest id that is not null (null if none). An empty table gives an
empty result. Only the id and the text column are read, so other columns cannot clash.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import partitions_for, scratch
from tidemark.llm._components import components

SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 2
#: Positions that two fingerprints within the distance share at least.
LEAST_SHARED = 8 - DISTANCE
#: Lists that are longer are dealt anew by two more byte positions.
LIST_LIMIT = 4096
#: Shingles whose bits are counted in one pass: a long text needs no more memory than this.
PASS = 1 << 16
#: The choices of two of the four byte pairs (bytes 0 1, 2 3, 4 5, 6 7).
CHOICES = tuple(combinations(range(4), 2))


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one UTF-8 text: a bit is set if more than half of the shingle hashes have it."""
    words = text.lower().split()  # bytes: A-Z alone are lowered, and white space is \x20 and \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    last = ends[size - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(first)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, PASS):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first[at : at + PASS], last[at : at + PASS], strict=True)], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(id_col, fp long): the fingerprint of each text as a signed 64-bit number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id_col, "fp"])

    rows = df.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_t"))
    return rows.mapInArrow(scan, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp long")


def forest(members: np.ndarray, distance: int = DISTANCE, tally: bool = True) -> list[tuple[int, np.ndarray]]:
    """(x, [y, ...]): links that connect what the links of distinct fingerprints connect, at most one for each y.

    The shared positional bytes of a pair are tallied first; only pairs that reach the guaranteed minimum are
    verified by their bits. Where a list is already keyed by six positions the tally is known.
    """
    left, found = members, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            differ = left ^ x
            if tally:
                at = np.flatnonzero((differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= LEAST_SHARED)
                at = at[np.bitwise_count(differ[at]) <= distance]
            else:
                at = np.flatnonzero(np.bitwise_count(differ) <= distance)
            if len(at):
                near = left[at]
                found.append((x, near))
                queue.extend(near)
                left = np.delete(left, at)
    return found


def _lists(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(key, fingerprints, whole): the lists of a sorted partition; one above the limit comes in parts that are not whole."""
    key, held, n, split = None, [], 0, False
    for batch in batches:
        keys, values = (batch.column(i).to_numpy() for i in range(2))
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if a == b:
                continue
            if keys[a] != key:
                if split or n > 1:
                    yield key, np.concatenate(held), not split
                key, held, n, split = keys[a], [], 0, False
            held.append(values[a:b])
            n += b - a
            if limit is not None and n > limit:
                yield key, np.concatenate(held), False
                held, n, split = [values[:0]], 0, True
    if held and (split or n > 1):
        yield key, np.concatenate(held), not split


def _scan(limit: int | None, distance: int, tally: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, members, whole in _lists(batches, limit):
            members = members.view(np.uint64)
            if whole:
                links = forest(members, distance, tally)
                a = np.concatenate([np.full(len(y), x) for x, y in links]) if links else members[:0]
                b = pa.array(np.concatenate([y for _, y in links]).view(np.int64) if links else members[:0].view(np.int64))
            else:
                a, b = members, pa.nulls(len(members), pa.int64())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), key, np.int64)), pa.array(a.view(np.int64)), b], ["key", "a", "b"])

    return scan


def _byte(i: int):
    return F.shiftrightunsigned("fp", 56 - 8 * i).bitwiseAND(F.lit(255))


def _keyed(number, positions: tuple[int, ...]):
    key = number
    for i in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(i))
    return key


def links(fps: DataFrame, distance: int = DISTANCE, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(a, b): links of distinct fingerprints `fp` that connect exactly what all pairs within the distance connect."""
    if distance > DISTANCE:
        raise ValueError(f"the index guarantees links of up to {DISTANCE} differing bits")
    spark = fps.sparkSession
    n = partitions_for(spark)
    places = [tuple(x for p in choice for x in (2 * p, 2 * p + 1)) for choice in CHOICES]
    keys = F.array(*[_keyed(F.lit(c).cast("long"), p) for c, p in enumerate(places)])
    entries = fps.select(F.explode(keys).alias("key"), "fp").repartition(n, "key").sortWithinPartitions("key", "fp")
    first = scratch(spark, entries.mapInArrow(_scan(list_limit, distance, True), "key long, a long, b long"), "simhash-lists")
    # long lists: the choice stands above the four bytes of the key
    long = first.where("b is null").select("key", F.col("a").alias("fp"))
    finer = None
    for c, p in enumerate(places):
        others = [i for i in range(8) if i not in p]
        more = F.array(*[_keyed(F.lit(8 * c + m).cast("long"), (*p, *two)) for m, two in enumerate(combinations(others, 2))])
        part = long.where(F.shiftrightunsigned("key", 32) == c).select(F.explode(more).alias("key"), "fp")
        finer = part if finer is None else finer.unionByName(part)
    second = finer.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_scan(None, distance, False), "key long, a long, b long")
    return first.where("b is not null").select("a", "b").unionByName(second.select("a", "b"))


def near_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, distance: int = DISTANCE, list_limit: int = LIST_LIMIT
) -> DataFrame:
    """(id_col, fp, component_id): each row with the smallest id reachable over links of its fingerprint."""
    spark = df.sparkSession
    rows = scratch(spark, fingerprints(df, id_col, text_col, size), "simhash-rows")
    # one entry for each fingerprint, summed before the exchange: copies do not grow the index
    entries = scratch(spark, rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-entries")
    roots = components(links(entries.select("fp"), distance, list_limit))
    linked = entries.join(roots, entries.fp == roots.node)
    named = linked.select("fp", "root").join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    every = entries.join(named.withColumn("_linked", F.lit(True)), "fp", "left")
    every = every.select("fp", F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    # written, so that the join with the rows reads both sides from shuffles and a fingerprint of many rows can be split
    every = scratch(spark, every, "simhash-named")
    return rows.join(every, "fp").select(id_col, "fp", "component_id")


def op11_simhash_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    classes = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
