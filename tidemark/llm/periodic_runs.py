"""Periodic runs of words, found on tiles scaled to the period.

A run is a stretch of words with smallest period q (words q apart are equal) of at least max(6, 4 q) words that
no neighbour extends. The periods are taken by octaves [2**k, 2**(k + 1)). For an octave, boundaries stand
every S = 2**(k + 1) words; the tile of a boundary reaches S words to its left, and S words and the longest
period of the octave to its right. For each period the two Z-functions of the boundary (how far the words from
it on, and before it, equal those one period further) give the fragment of matching places inside the tile. The
matching places of a run are 3 q or more, so they meet a boundary; fragments that a tile cuts off go on in the
next tile, and all others that are shorter than 3 q are no runs. A fragment whose first q words repeat a shorter
word is no run of that period; this is the same for every fragment of a run, so a tile decides it alone.

Documents of up to `long_chars` characters are solved whole where they are read, all tiles of an Arrow batch in
one numpy pass. Longer ones are exploded into tiles (the octaves up to `LOW` share a tile of `CORE` words, each
higher octave has tiles of eight of its longest periods), dealt over the tasks and solved independently. The
fragments are shuffled by text and period and stitched to intervals; only then is the length decided.

Words are compared by 64-bit hashes, and stretches by prefix sums modulo two primes of 31 bits, so two unequal
ones pass as equal with a probability of about 1e-18 for each comparison. Texts are known by their SHA-256:
equal texts share their runs, whatever their ids. Null and empty texts have no words and no runs; repeated rows
each keep their row; an empty table gives an empty result; only the id and the text column are read.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._common import slices, scratch, word_bounds, word_hashes

LONG_CHARS = 32_768
#: Words of a tile that the octaves of periods below 2**LOW share, without its margins.
LOW, CORE = 10, 8192
_PRIMES = (2147483647, 2147483629)
_BASES = (1103515245, 1664525017)
_FRAGMENTS = "array<struct<q:long,lo:long,hi:long>>"


def least_length(q):
    """The words that a run of period q has at least."""
    return np.maximum(6, 4 * q)


@lru_cache(maxsize=4)
def _powers(size: int, which: int) -> np.ndarray:
    p, base = np.uint64(_PRIMES[which]), _BASES[which]
    have = np.ones(1, np.uint64)
    while len(have) < size:
        have = np.concatenate((have, have * np.uint64(pow(base, len(have), int(p))) % p))
    return have


@lru_cache(maxsize=2)
def _smallest_prime(size: int) -> np.ndarray:
    found = np.arange(size, dtype=np.int32)
    for p in range(2, int(size**0.5) + 1):
        if found[p] == p:
            part = found[p * p :: p]
            part[part == np.arange(p * p, size, p, dtype=np.int32)] = p
    return found


class _Words:
    """Word hashes with prefix sums, to compare stretches of them."""

    def __init__(self, words: np.ndarray):
        self.words, self.size = words, len(words)
        width = 1 << max(10, self.size.bit_length())
        self.powers = [_powers(width, i) for i in (0, 1)]
        self.sums = []
        for i, p in enumerate(map(np.uint64, _PRIMES)):
            total = np.zeros(self.size + 1, np.uint64)
            np.cumsum(words % p * self.powers[i][: self.size] % p, out=total[1:])
            self.sums.append(total % p)

    def same(self, i: np.ndarray, j: np.ndarray, n) -> np.ndarray:
        """Whether the n words from i on equal those from j on; j is not below i."""
        equal = True
        for power, total, p in zip(self.powers, self.sums, map(np.uint64, _PRIMES), strict=True):
            left = (total[i + n] + p - total[i]) % p * power[j - i] % p
            equal = equal & (left == (total[j + n] + p - total[j]) % p)
        return equal

    def reach(self, at: np.ndarray, q: np.ndarray, most: np.ndarray, step: int, back: bool) -> np.ndarray:
        """The Z-values: how many words from `at` on (or before it) equal those q further, `most` at most."""
        found = np.zeros(len(at), np.int64)
        while step and len(at):
            fits = np.flatnonzero(found + step <= most)
            start = at[fits] - found[fits] - step if back else at[fits] + found[fits]
            found[fits[self.same(start, start + q[fits], step)]] += step
            step //= 2
        return found


def fragments(text: _Words, boundaries: np.ndarray, octave: int) -> np.ndarray:
    """Rows (q, lo, hi): for places lo up to hi the word q further is equal, around the boundaries of an octave."""
    half, size = 1 << octave, text.size
    reach = 2 * half
    shifts = np.arange(half, reach)
    found = []
    width = max(1, (1 << 20) // half)
    for first in range(0, len(boundaries), width):
        at = boundaries[first : first + width]
        target = at[:, None] + shifts
        equal = (text.words[np.minimum(target, size - 1)] == text.words[at][:, None]) & (target < size)
        row, column = np.nonzero(equal)
        b, q = at[row], shifts[column]
        ahead, behind = np.minimum(reach, size - b - q), np.minimum(reach, b)
        # a fragment that counts has 2 * half places or more, so half of them on one side
        likely = np.zeros(len(b), bool)
        for side, start in ((ahead, b), (behind, b - half)):
            fits = np.flatnonzero((side >= half) & ~likely)
            likely[fits] = text.same(start[fits], start[fits] + q[fits], half)
        b, q, ahead, behind = (x[likely] for x in (b, q, ahead, behind))
        right = text.reach(b, q, ahead, reach, False)
        left = text.reach(b, q, behind, reach, True)
        keep = (right + left >= least_length(q) - q) | (right == reach) | (left == reach)
        q, lo, hi = q[keep], (b - left)[keep], (b + right)[keep]
        keep = ~_repeats_shorter(text, lo, q)
        found.append(np.stack((q[keep], lo[keep], hi[keep]), axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _repeats_shorter(text: _Words, lo: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the q words from lo on are a shorter word several times."""
    shorter = np.zeros(len(q), bool)
    if not len(q):
        return shorter
    prime = _smallest_prime(1 << int(q.max()).bit_length())
    rest = q.copy()
    while (open_ := np.flatnonzero((rest > 1) & ~shorter)).size:
        p = prime[rest[open_]].astype(np.int64)
        period = q[open_] // p
        shorter[open_] = text.same(lo[open_], lo[open_] + period, q[open_] - period)
        rest[open_] //= p
    return shorter


def merged(rows: np.ndarray) -> np.ndarray:
    """Fragments of one period that meet or overlap, as one."""
    if len(rows) < 2:
        return rows
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    # pieces of one stretch are cut by windows of one size, so their ends ascend with their starts
    opens = np.flatnonzero(np.concatenate(([True], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] > rows[:-1, 2]))))
    return np.stack((rows[opens, 0], rows[opens, 1], np.maximum.reduceat(rows[:, 2], opens)), axis=1)


def batch_fragments(words: np.ndarray, first_word: np.ndarray) -> list[np.ndarray]:
    """Fragments of each row of a batch; first_word[r] is the index of the first word of row r (and a total)."""
    rows = len(first_word) - 1
    # a word between rows that equals nothing: its value is its own
    starts = first_word[:-1] + np.arange(rows)
    line = np.empty(len(words) + rows, np.uint64)
    gaps = first_word[1:] + np.arange(rows)
    inside = np.ones(len(line), bool)
    inside[gaps] = False
    line[inside] = words
    line[gaps] = np.arange(rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567890ABCDEF)
    length = np.diff(first_word)
    text, found, octave = _Words(line), [], 0
    while len(length) and least_length(1 << octave) <= length.max():
        at = np.arange(0, len(line), 2 << octave)
        row = np.searchsorted(starts, at, "right") - 1
        at = at[(length[row] >= least_length(1 << octave)) & inside[at]]
        found.append(fragments(text, at, octave))
        octave += 1
    every = merged(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)
    row = np.searchsorted(starts, every[:, 1], "right") - 1
    every[:, 1:] -= starts[row][:, None]
    order = np.argsort(row, kind="stable")
    return np.split(every[order], np.searchsorted(row[order], np.arange(1, rows)))


def tiles(n: int, low: int = LOW, core: int = CORE) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(first octave, last octave + 1, first and last boundary word, first and last word) of the tiles of n words."""
    last = 0
    while least_length(1 << last) <= n:
        last += 1
    groups = [(0, min(low, last), core)] + [(k, k + 1, 8 << k + 1) for k in range(low, last)]
    for first, end, width in groups:
        reach = 1 << end
        for at in range(0, n, width):
            yield first, end, at, min(n, at + width), max(0, at - reach), min(n, at + width + 2 * reach)


def _text_words(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]))
    return word_hashes(raw, starts, ends)


def _array(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
    entries = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["q", "lo", "hi"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), entries)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, text if the text has fragments, n words, digest of all words, fragments)."""
    for batch in batches:
        for first, last, raw, row_at in slices(batch.column(2)):
            starts, ends, first_word = word_bounds(raw, row_at)
            found = batch_fragments(word_hashes(raw, starts, ends), first_word)
            part = batch.slice(first, last - first)
            texts = [t.as_py() for t in part.column(2)]
            plain = [None if len(f) else _digest(t.encode().split()) for t, f in zip(texts, found, strict=True)]
            kept = pa.array([t if len(f) else None for t, f in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), kept, pa.array(np.diff(first_word)), pa.array(plain, pa.string()), _array(found)],
                ["key", "id", "text", "n", "plain", "found"],
            )


def _explode(low: int, core: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "k0", "k1", "b0", "b1", "start", "words"]
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = _text_words(text.as_py().encode())
                for k0, k1, b0, b1, start, end in tiles(len(words), low, core):
                    row = [key.as_py(), k0, k1, b0, b1, start, words[start:end].tobytes()]
                    kinds = [pa.binary(), *[pa.int64()] * 5, pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names)

    return explode


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, rows = [], []
        for key, k0, k1, b0, b1, start, words in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            text = _Words(np.frombuffer(words, np.uint64))
            each = []
            for k in range(k0, k1):
                step = 2 << k
                each.append(fragments(text, np.arange(-(-b0 // step) * step, b1, step) - start, k))
            found = merged(np.concatenate(each)) if each else np.zeros((0, 3), np.int64)
            found[:, 1:] += start
            keys += [key] * len(found)
            rows.append(found)
        flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *[pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)]], ["key", "q", "lo", "hi"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without the words of a run behind its first q, words joined by one space."""
    for batch in batches:
        out = []
        for text, runs in zip(batch.column(2), batch.column(3), strict=True):
            words = text.as_py().encode().split()
            edge = np.zeros(len(words) + 1, np.int64)
            for run in runs.as_py() or ():
                edge[run["start"] + run["period"]] += 1
                edge[run["start"] + run["length"]] -= 1
            keep = np.cumsum(edge[:-1]) == 0
            out.append(b" ".join([words[i] for i in np.flatnonzero(keep).tolist()]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.decode() for x in out], pa.string()), batch.column(3)], ["key", "id", "collapsed", "runs"])


def stitched(found: DataFrame) -> DataFrame:
    """(key, start, length, period): the runs of fragments (key, q, lo, hi) of all tiles."""
    w = Window.partitionBy("key", "q").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    pieces = found.distinct().withColumn("opens", (before.isNull() | (F.col("lo") > before)).cast("int"))
    islands = pieces.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("key", "q", "island").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + F.col("q")).alias("length"))
    return whole.where(F.col("length") >= F.greatest(F.lit(6), 4 * F.col("q"))).select("key", "start", "length", F.col("q").alias("period"))


def _with_fragments(df: DataFrame, id_col: str, text_col: str, long_chars: int, low: int, core: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, id, text, n, plain, found), text null where a text has no fragment, and the runs of all texts."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.unhex(F.sha2(text, 256)).alias("key"), F.col(id_col).alias("id"), text.alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    short = docs.where(F.length("text") <= long_chars).mapInArrow(_short, f"key binary, id {id_type}, text string, n long, plain string, found {_FRAGMENTS}")
    long = docs.where(F.length("text") > long_chars)
    rows = short.unionByName(long.select("key", "id", "text", F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("plain"), F.lit(None).cast(_FRAGMENTS).alias("found")))
    rows = scratch(spark, rows, "runs-rows")
    cut = long.select("key", "text").mapInArrow(_explode(low, core), "key binary, k0 long, k1 long, b0 long, b1 long, start long, words binary")
    tiled = cut.repartition("key", "k0", "b0").mapInArrow(_solve, "key binary, q long, lo long, hi long")
    whole = rows.select("key", F.explode("found").alias("f")).select("key", "f.q", "f.lo", "f.hi")
    return rows, stitched(whole.unionByName(tiled))


def periodic_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_chars: int = LONG_CHARS, low: int = LOW, core: int = CORE
) -> DataFrame:
    """(id_col, runs, collapsed, collapsed_sha256): the runs of each row by start, then period, and what is left.

    runs is an array of (start, period, length) in words. Where a text has no run, `collapsed` is null and only
    the digest of its words, joined by one space, is given, so that such texts do not travel.
    """
    rows, runs = _with_fragments(df, id_col, text_col, long_chars, low, core)
    of_text = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    id_type = rows.schema["id"].dataType.simpleString()
    kind = of_text.schema["runs"].dataType.simpleString()
    some = rows.where("text is not null").select("key", "id", "text").join(of_text, "key", "left").select("key", "id", "text", "runs")
    some = some.mapInArrow(_collapse, f"key binary, id {id_type}, collapsed string, runs {kind}")
    some = some.select("id", F.coalesce("runs", F.array().cast(kind)).alias("runs"), "collapsed", F.sha2("collapsed", 256).alias("collapsed_sha256"))
    none = rows.where("text is null").select("id", F.array().cast(kind).alias("runs"), F.lit(None).cast("string").alias("collapsed"), F.col("plain").alias("collapsed_sha256"))
    return some.unionByName(none).withColumnRenamed("id", id_col)


def planted(df: DataFrame) -> DataFrame:
    """(doc_id, text): `documents` in which a tenth of the texts repeat some of their words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    chosen = (h % 10 == 0) & F.col("text").isNotNull()
    rows = df.select("doc_id", "text", F.when(chosen, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"), g.alias("g"))
    n = F.size("w")
    rows = rows.withColumn("a", F.when(n > 0, F.pmod("g", n)).cast("int"))
    rows = rows.withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    # whole slices: a lambda over the words would let the optimiser split the text again for each of them
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    words = F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(F.array_repeat(period, F.ceil((n - F.col("a")) / F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(n > 0, F.array_join(F.slice(words, F.lit(1), n), " ")).otherwise(F.col("text")).alias("text"))


def op12_scale_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document with its planted repetitions, and a digest of what is left without them."""
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["s"]).alias("start"),
        best["length"].alias("length"),
        (-best["p"]).alias("period"),
        F.floor(1000 * best["length"] / -best["p"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
