"""Ranked word search (Okapi BM25) over a written index, with upper bounds by block.

Documents are numbered in the order of their keys, in segments as for the trigram index. For each word and segment
the index keeps the places that hold it (made where the documents lie, in passes of `PASS_ENTRIES`, without a shuffle), the word's gain there (its BM25 weight without the inverse document
frequency) and for every block of `BLOCK` places the largest gain. A query adds the largest gains of its words by
block, scores the blocks in the order of these bounds, and stops at the first bound below its k-th best score:
documents that only share common words with the query are not scored. A segment is one group, whatever the words,
and gives k documents for each query.

Rows with a null key or text are not in the index; a text without words counts as a document of length 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sequence import top
from tidemark.session import shared_folder

BLOCK = 32
SEGMENT_CHARS = 16 << 20
WORDS = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class WordIndex:
    """postings: word, seg, n, places, gains, blocks, tops; rows: seg, place, key, len."""

    postings: DataFrame
    rows: DataFrame
    n: int
    path: str


def words_of(text) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


#: Entries (a word of a document) whose lists are made at once.
PASS_ENTRIES = 1 << 21


def _lists(average: float, block: int):
    """(word, seg, n, places, gains, blocks, tops) of slices of (seg, place, len, words, times)."""

    def made(seg: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        place, length = (rows.column(i).to_numpy() for i in (1, 2))
        words = pa.concat_arrays([c.flatten() for c in rows.column(3).chunks]).dictionary_encode()
        tf = pa.concat_arrays([c.flatten() for c in rows.column(4).chunks]).to_numpy()
        doc = np.repeat(np.arange(len(place)), pc.list_value_length(rows.column(3)).to_numpy())
        code = words.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        row, doc, tf = code[order], doc[order], tf[order]
        place = place[doc]
        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / average))
        offsets = np.searchsorted(row, np.arange(len(words.dictionary) + 1))
        opens = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] // block != place[:-1] // block)))) if len(row) else np.zeros(0, np.int64)
        tops = np.maximum.reduceat(gain, opens) if len(opens) else np.zeros(0)
        cut = np.searchsorted(row[opens], np.arange(len(words.dictionary) + 1))
        listed = lambda at, x, t: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, t))
        return pa.RecordBatch.from_arrays(
            [words.dictionary, pa.array(np.full(len(words.dictionary), seg), pa.int32()), pa.array(np.diff(offsets), pa.int32()), listed(offsets, place, pa.int32()),
             listed(offsets, gain, pa.float64()), listed(cut, place[opens] // block, pa.int32()), listed(cut, tops, pa.float64())],
            ["word", "seg", "n", "places", "gains", "blocks", "tops"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seg, many = [], None, 0
        for batch in batches:
            segs = batch.column(0).to_numpy()
            end = np.cumsum(pc.list_value_length(batch.column(3)).to_numpy())
            begin = 0
            while begin < batch.num_rows:
                if held and (segs[begin] != seg or many >= PASS_ENTRIES):
                    yield made(seg, held)
                    held, many = [], 0
                seg, before = segs[begin], end[begin - 1] if begin else 0
                stop = begin + int(np.searchsorted(segs[begin:] != seg, True))  # segments follow one another
                stop = max(begin + 1, min(stop, int(np.searchsorted(end, before + PASS_ENTRIES - many, "right"))))
                held.append(batch.slice(begin, stop - begin))
                many += int(end[stop - 1] - before)
                begin = stop
                if begin < batch.num_rows and segs[begin] == seg:
                    many = PASS_ENTRIES  # the rest of the segment goes to the next pass
        if held:
            yield made(seg, held)

    return scan


def build(docs: DataFrame, key: str, text: str, segment_chars: int = SEGMENT_CHARS, block: int = BLOCK, path: str | None = None) -> WordIndex:
    """Writes the index of docs(key, text): each text is split once."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    ordered = rows.repartitionByRange(max(1, -(-int(chars) // segment_chars)), "key").sortWithinPartitions("key", F.xxhash64("text"))
    number = F.monotonically_increasing_id()
    numbered = ordered.select(F.shiftright(number, 33).cast("int").alias("seg"), number.bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("place"), "key", words_of(F.col("text")).alias("words"))
    kind = rows.schema["key"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(3).flatten().dictionary_encode()
            length = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            size = max(1, len(words.dictionary))
            pairs, times = np.unique(np.repeat(np.arange(batch.num_rows), length) * size + words.indices.to_numpy(), return_counts=True)
            cut = pa.array(np.searchsorted(pairs, np.arange(batch.num_rows + 1) * size), pa.int32())
            listed = [pa.ListArray.from_arrays(cut, x) for x in (words.dictionary.take(pa.array(pairs % size)), pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(length, pa.int32()), *listed], ["seg", "place", "key", "len", "words", "times"])

    counted = numbered.mapInArrow(count, f"seg int, place int, key {kind}, len int, words array<string>, times array<int>")
    counted.write.parquet(f"{path}/rows")
    rows = spark.read.schema(counted.schema).parquet(f"{path}/rows")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()
    average = float(total.avg or 1.0) or 1.0
    ddl = "word string, seg int, n int, places array<int>, gains array<double>, blocks array<int>, tops array<double>"
    rows.select("seg", "place", "len", "words", "times").mapInArrow(_lists(average, block), ddl).write.parquet(f"{path}/postings")
    return WordIndex(spark.read.parquet(f"{path}/postings"), rows.select("seg", "place", "key", "len"), total.n, path)


def reopened(spark: SparkSession, path: str) -> WordIndex:
    """An index that was written before, by any session."""
    rows = spark.read.parquet(f"{path}/rows").select("seg", "place", "key", "len")
    return WordIndex(spark.read.parquet(f"{path}/postings"), rows, rows.count(), path)


def best_places(lists: list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int, block: int = BLOCK, places: int = 6) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, documents scored): the k best of a segment; lists: (idf, places, gains, blocks, tops) of each word."""
    blocks = np.concatenate([x[3] for x in lists])
    ids, which = np.unique(blocks, return_inverse=True)
    bound = np.bincount(which, np.concatenate([x[0] * x[4] for x in lists]))
    order = np.argsort(-bound, kind="stable")
    found_at, found, floor, at, width, scored = np.zeros(0, np.int64), np.zeros(0), -np.inf, 0, 1, 0
    slack = 10.0**-places
    while at < len(order) and bound[order[at]] + slack >= floor:
        chosen = order[at : at + width]
        chosen = np.sort(ids[chosen[bound[chosen] + slack >= floor]])
        at, width = at + width, min(width * 2, 64)
        wanted, gains = [], []
        for idf, place, gain, _, _ in lists:
            begin, end = np.searchsorted(place, chosen * block), np.searchsorted(place, (chosen + 1) * block)
            many = end - begin
            mine = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
            wanted.append(place[mine])
            gains.append(idf * gain[mine])
        docs, which = np.unique(np.concatenate(wanted), return_inverse=True)
        score = np.round(np.bincount(which, np.concatenate(gains)), places) if len(docs) else np.zeros(0)
        scored += len(docs)
        found_at, found = np.concatenate((found_at, docs)), np.concatenate((found, score))
        if len(found) >= k:
            best = np.lexsort((found_at, -found))[:k]
            found_at, found = found_at[best], found[best]
            floor = found[-1]
    best = np.lexsort((found_at, -found))[:k]
    return found_at[best], found[best], scored


def _scorer(sent, k: int, block: int, places: int):
    """The k best places of a segment for each query of a broadcast [(name, {word: idf})]."""

    def score(group: pd.DataFrame) -> pd.DataFrame:
        parts: dict[str, list] = {}
        for w, *rest in group[["word", "places", "gains", "blocks", "tops"]].itertuples(index=False):
            parts.setdefault(w, []).append([np.asarray(x) for x in rest])
        # the lists of several passes; a block on the border has two tops, whose sum is a bound as well
        held = {w: some[0] if len(some) == 1 else [np.concatenate(x) for x in zip(*sorted(some, key=lambda p: p[0][0]), strict=True)] for w, some in parts.items()}
        found = []
        for name, words in sent.value:
            lists = [(idf, *held[w]) for w, idf in words.items() if w in held]
            if lists:
                at, scores, _ = best_places(lists, k, block, places)
                found += [(name, group["seg"].iloc[0], p, s) for p, s in zip(at.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(found, columns=["q", "seg", "place", "score"])

    return score


#: Words of stated queries that go to the tasks at once.
BLOCK_WORDS = 1 << 18


def topk(queries: DataFrame, index: WordIndex, q: str, text: str, key: str, k: int, block: int = BLOCK, places: int = 6) -> DataFrame:
    """(q, key, score, rank): the k best documents of each query; ties go to the smaller key."""
    spark = queries.sparkSession
    wanted = queries.where(F.col(q).isNotNull()).select(F.col(q).alias("q"), F.explode(F.array_distinct(words_of(F.col(text)))).alias("word"))
    df = index.postings.select("word", "n").join(wanted.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("df"))
    wanted = wanted.join(df, "word").select("q", "word", F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    n = max(1, -(-wanted.count() // BLOCK_WORDS))
    kinds = wanted.schema["q"].dataType.simpleString()
    out = None
    for number in range(n):
        part = wanted if n == 1 else wanted.where(F.pmod(F.xxhash64("q"), F.lit(n)) == number)
        rows = part.toPandas()  # a block of stated words
        asked = [(name, dict(zip(g["word"], g["idf"], strict=True))) for name, g in rows.groupby("q")]
        sent = spark.sparkContext.broadcast(asked)

        # a block's words are sent to the postings, which are not shuffled for them
        stated = F.broadcast(spark.createDataFrame(rows[["word"]].drop_duplicates(), "word string"))
        mine = index.postings.join(stated, "word", "left_semi")
        found = mine.groupBy("seg").applyInPandas(_scorer(sent, k, block, places), f"q {kinds}, seg int, place int, score double")
        out = found if out is None else out.unionByName(found)
    # places and segments are in the order of the keys
    best = top(out, ["q"], [F.desc("score"), "seg", "place"], k)
    return best.join(index.rows.select("seg", "place", "key"), ["seg", "place"]).select(F.col("q").alias(q), F.col("key").alias(key), "score", "rank")
