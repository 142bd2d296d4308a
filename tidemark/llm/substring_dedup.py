"""Substring dedup with fixed-block anchors.

Any window of `size` words holds a whole block of the grid of (size + 1) // 2 words, wherever the grid
lies. So the blocks of every document's grid are the index, and every rolling window of the block's
length probes it: a block that meets another position is an anchor. The windows of `size` words around
anchors are then compared with each other by 96-bit hashes of their words, which extends each anchor to
the full exact repeat; words under a window that starts twice or more are removed, in all its copies.

Documents are dealt into groups by a hash; a group's windows travel as packed arrays of distinct hashes
in buckets by hash, and the answers come back as bits. A window that is common to a third of all
documents so costs one entry for each group, and no task holds more than a bucket or a group. Both are
set from the measured size of the texts. The whole is one plan without intermediate tables: lost
executors are recovered from lineage.

Null or empty text has no words. Repeated rows are two documents (all their windows repeat). Only the
id and the text column are read. An empty table gives an empty result.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import covered, partitions_for, slices, window_hashes, windows_of_rows, word_bounds, word_hashes

SIZE = 35
#: Text of one group: between these, about a two-thousandth of all.
GROUP_BYTES = (4 << 20, 64 << 20)
#: Text whose probes fill one bucket.
BUCKET_BYTES = 12 << 20

_LOW = np.uint64(0xFFFFFFFF)


@dataclass
class Slice:
    """Some rows of a group: their words, and the hashes of their block-long windows."""

    first: int
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first_word: np.ndarray
    words: np.ndarray
    at: np.ndarray
    aligned: np.ndarray
    probes: np.ndarray


def _slices(texts: pa.ChunkedArray, block: int) -> list[Slice]:
    out = []
    for first, _, raw, row_at in slices(texts.combine_chunks()):
        starts, ends, first_word = word_bounds(raw, row_at)
        words = word_hashes(raw, starts, ends)
        at, row = windows_of_rows(first_word, block)
        probes = window_hashes(words, block)[at] if len(at) else np.zeros(0, np.uint64)
        out.append(Slice(first, raw, starts, ends, first_word, words, at, (at - first_word[:-1][row]) % block == 0, probes))
    return out


def _ranked(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct tuples of the keys, in their order, and the rank of every entry's tuple."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([np.diff(k[order]) != 0 for k in keys])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order[new], rank


def _bucket_key(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket in the upper half, the lower half of the hash in the lower."""
    return (hashes >> np.uint64(32)) % np.uint64(n_buckets) << np.uint64(32) | (hashes & _LOW)


def _packed(group: int, keys: np.ndarray, *columns: np.ndarray) -> dict[str, list]:
    """Rows of (bucket, group, lower halves, packed flags...) from sorted keys."""
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
    rows: dict[str, list] = {"bucket": [], "grp": [], "low": [], **{f"c{i}": [] for i in range(len(columns))}}
    low = (keys & _LOW).astype(np.uint32)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        rows["bucket"].append(int(bucket[a]))
        rows["grp"].append(group)
        rows["low"].append(low[a:b].tobytes())
        for i, c in enumerate(columns):
            rows[f"c{i}"].append(np.packbits(c[a:b]).tobytes() if c.dtype == bool else c[a:b].tobytes())
    return rows


def _flags(table: pa.Table, step: int, distinct: np.ndarray) -> np.ndarray:
    """The answers of a step to a group's distinct keys, in their order."""
    out = np.zeros(len(distinct), bool)
    bucket = (distinct >> np.uint64(32)).astype(np.int64)
    for row in table.to_pylist():
        if row["step"] == step:
            a, b = np.searchsorted(bucket, [row["bucket"], row["bucket"] + 1])
            out[a:b] = np.unpackbits(np.frombuffer(row["hits"], np.uint8), count=b - a).astype(bool)
    return out


def _hit_windows(parts: list[Slice], answers: pa.Table, n_buckets: int) -> list[np.ndarray]:
    """For each slice, which probes are anchors."""
    keys = [_bucket_key(p.probes, n_buckets) for p in parts]
    every = np.concatenate(keys)
    at, rank = _ranked(every)
    hit = _flags(answers, 1, every[at])
    return np.split(hit[rank], np.cumsum([len(k) for k in keys[:-1]]))


def _candidates(parts: list[Slice], anchors: list[np.ndarray], size: int, block: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice, the starts of the windows that hold an anchor and their two hashes."""
    out = []
    for p, hit in zip(parts, anchors, strict=True):
        at, _ = windows_of_rows(p.first_word, size)
        total = np.zeros(len(p.words) + 1, np.int32)
        total[p.at[hit] + 1] = 1
        np.cumsum(total, out=total)
        at = at[total[at + size - block + 1] > total[at]] if hit.any() else at[:0]
        if not len(at):
            out.append((at, np.zeros(0, np.uint64), np.zeros(0, np.uint32)))
            continue
        second = word_hashes(p.raw, p.starts, p.ends, 1)
        out.append((at, window_hashes(p.words, size)[at], (window_hashes(second, size, 1)[at] & _LOW).astype(np.uint32)))
    return out


def _wide(candidates: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The 96-bit keys of all slices as two columns: bucket and lower half, upper half and second hash."""
    one, two = (np.concatenate([c[i] for c in candidates]) for i in (1, 2))
    return _bucket_key(one, n_buckets), (one & ~_LOW) | two


def repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, text, kept binary): each text, and the bits of its words that no repeated window covers."""
    return _plan(df, id_col, text_col, size, "bits")


def repeat_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    return _plan(df, id_col, text_col, size, "digest")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, text): the kept words of every row, joined by one space."""
    return _plan(df, id_col, text_col, size, "text")


def _plan(df: DataFrame, id_col: str, text_col: str, size: int, result: str) -> DataFrame:
    spark, block = df.sparkSession, (size + 1) // 2
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    n_bytes = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    group_bytes = min(max(n_bytes // 2000, GROUP_BYTES[0]), GROUP_BYTES[1])
    n_groups = max(partitions_for(spark), -(-n_bytes // group_bytes))
    n_buckets = max(partitions_for(spark), -(-n_bytes // BUCKET_BYTES))
    docs = texts.withColumn("grp", F.pmod(F.xxhash64("id", "text"), F.lit(n_groups)).cast("int"))

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        parts = _slices(table["text"], block)
        keys = np.concatenate([_bucket_key(p.probes, n_buckets) for p in parts])
        at, rank = _ranked(keys)
        indexed = np.zeros(len(at), bool)
        indexed[rank[np.concatenate([p.aligned for p in parts])]] = True
        return pa.table(_packed(key[0].as_py(), keys[at], indexed, np.bincount(rank, minlength=len(at)) > 1), probe_schema)

    def anchor(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lows = [np.frombuffer(r["low"], np.uint32) for r in rows]
        bits = lambda name: np.concatenate([np.unpackbits(np.frombuffer(r[name], np.uint8), count=len(x)) for r, x in zip(rows, lows, strict=True)]).astype(bool)
        return _answer(1, key[0].as_py(), rows, lows, [np.concatenate(lows)], bits("c1"), bits("c0"))

    def _answer(step: int, bucket: int, rows: list[dict], lows: list[np.ndarray], keys: list[np.ndarray], again: np.ndarray, indexed: np.ndarray | None) -> pa.Table:
        _, rank = _ranked(*keys)
        hit = np.bincount(rank) > 1
        hit[rank[again]] = True
        if indexed is not None:
            known = np.zeros(len(hit), bool)
            known[rank[indexed]] = True
            hit &= known
        flag = hit[rank]
        out: dict[str, list] = {"grp": [], "step": [], "bucket": [], "hits": []}
        at = 0
        for r, x in zip(rows, lows, strict=True):
            mine = flag[at : at + len(x)]
            at += len(x)
            if mine.any():
                for name, value in (("grp", r["grp"]), ("step", step), ("bucket", bucket), ("hits", np.packbits(mine).tobytes())):
                    out[name].append(value)
        return pa.table(out, answer_schema)

    def extend(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return extend_schema.empty_table()
        parts = _slices(table["text"], block)
        wide, rest = _wide(_candidates(parts, _hit_windows(parts, answers, n_buckets), size, block), n_buckets)
        at, rank = _ranked(wide, rest)
        return pa.table(_packed(key[0].as_py(), wide[at], rest[at], np.bincount(rank, minlength=len(at)) > 1), extend_schema)

    def match(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lows = [np.frombuffer(r["low"], np.uint32) for r in rows]
        rest = np.frombuffer(b"".join(r["c0"] for r in rows), np.uint64)
        again = np.concatenate([np.unpackbits(np.frombuffer(r["c1"], np.uint8), count=len(x)) for r, x in zip(rows, lows, strict=True)])
        return _answer(2, key[0].as_py(), rows, lows, [np.concatenate(lows), rest], again.astype(bool), None)

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return final_schema.empty_table()
        parts = _slices(table["text"], block)
        found = _candidates(parts, _hit_windows(parts, answers, n_buckets), size, block)
        wide, rest = _wide(found, n_buckets)
        first, rank = _ranked(wide, rest)
        hits = np.split(_flags(answers, 2, wide[first])[rank], np.cumsum([len(at) for at, _, _ in found[:-1]]))
        columns: list[list] = [[], [], []]
        for p, (at, _, _), hit in zip(parts, found, hits, strict=True):
            flags = np.zeros(len(p.words), bool)
            flags[at[hit]] = True
            gone = covered(flags, size, len(p.words))
            data = p.raw.tobytes()
            for a, b in zip(p.first_word[:-1], p.first_word[1:], strict=True):
                keep = np.flatnonzero(~gone[a:b]) + a
                if result == "bits":
                    columns[0].append(np.packbits(~gone[a:b]).tobytes())
                    continue
                text = b" ".join([data[i:j] for i, j in zip(p.starts[keep].tolist(), p.ends[keep].tolist(), strict=True)])
                if result == "text":
                    columns[0].append(text)
                    continue
                for column, value in zip(columns, (int(b - a), int(b - a - len(keep)), hashlib.sha256(text).hexdigest()), strict=True):
                    column.append(value)
        ids = table["id"].combine_chunks()
        if result == "digest":
            arrays = [ids, *columns]
        elif result == "text":
            arrays = [ids, pa.array(columns[0], pa.binary()).cast(pa.string())]
        else:
            arrays = [ids, table["text"].combine_chunks(), columns[0]]
        return pa.table([pa.array(x, f.type) if isinstance(x, list) else x.cast(f.type) for x, f in zip(arrays, final_schema, strict=True)], schema=final_schema)

    binary = lambda *names: [(n, pa.binary()) for n in names]
    probe_schema = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), *binary("low", "c0", "c1")])
    extend_schema = probe_schema  # c0 is the rest of the hash there
    answer_schema = pa.schema([("grp", pa.int32()), ("step", pa.int32()), ("bucket", pa.int32()), *binary("hits")])
    more = {
        "digest": "n_words long, n_removed long, kept_sha256 string",
        "text": "text string",
        "bits": "text string, kept binary",
    }[result]
    final_ddl = f"id {id_type}, {more}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    final_schema = to_arrow_schema(StructType.fromDDL(final_ddl))
    answer_ddl = "grp int, step int, bucket int, hits binary"
    probes = docs.groupBy("grp").applyInArrow(probe, "bucket int, grp int, low binary, c0 binary, c1 binary")
    anchors = probes.groupBy("bucket").applyInArrow(anchor, answer_ddl)
    windows = docs.groupBy("grp").cogroup(anchors.groupBy("grp")).applyInArrow(
        extend, "bucket int, grp int, low binary, c0 binary, c1 binary")
    matches = windows.groupBy("bucket").applyInArrow(match, answer_ddl)
    answers = anchors.unionByName(matches)
    done = docs.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(finish, final_ddl)
    return done.withColumnRenamed("id", "doc_id" if result == "digest" else id_col)


def op8_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text of `documents` under windows of 35 words that repeat."""
    return repeat_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
