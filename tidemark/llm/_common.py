"""Helpers shared by the operators: Arrow plumbing, word hashing and durable intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# The white space of every word rule in this package: space and \t \n \v \f \r.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240131)
_BYTE_CODE = _RNG.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Two bases and their inverses modulo 2**64.
_BASE = tuple(np.uint64(x) for x in (*_ODD, *(pow(x, -1, 2**64) for x in _ODD)))
#: Bytes of text that one numpy pass handles; a longer text is one pass of its own.
SLICE_BYTES = 1 << 20


def scratch(spark: SparkSession, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df as Parquet in the cluster's shared checkpoint folder and reads it back.

    This cuts the lineage: what follows restarts from the files when executors are lost. The folder
    is a fresh one in the session's checkpoint directory, or below the warehouse where none is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession) -> int:
    """The session's shuffle width, for repartition() calls that name a key."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows) in passes of about `limit` bytes.

    Null texts are empty.
    """
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads the entropy of 64-bit values over all their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, which: int = 0) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have) <= n:
        step = np.full(max(n + 1, 4096), _BASE[which], np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _POWERS[which] = have
    return have


def word_bounds(raw: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each row the index of its first word (plus a total)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(row_at), np.int64)
    inside = ~_IS_SPACE[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cut = row_at[(row_at > 0) & (row_at < n)]
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, row_at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every word, from prefix sums of a polynomial over its bytes.

    A long text goes in pieces of about `SLICE_BYTES`, cut between words, so that the sums never need more
    than a few times the bytes of a piece.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    if ends[-1] - starts[0] > 2 * SLICE_BYTES and len(starts) > 1:
        cuts = np.unique(np.searchsorted(starts, np.arange(starts[0] + SLICE_BYTES, ends[-1], SLICE_BYTES)))
        cuts = [0, *cuts[(cuts > 0) & (cuts < len(starts))].tolist(), len(starts)]
        return np.concatenate([_piece_hashes(raw[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a], which) for a, b in zip(cuts, cuts[1:], strict=False)])
    return _piece_hashes(raw, starts, ends, which)


def _piece_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    code = _BYTE_CODE[which]
    place = np.arange(len(raw), dtype=np.int64)
    length = ends - starts
    # the power of a byte is its place in its word, so that equal words have equal sums anywhere
    owner_start = np.zeros(len(raw), np.int64)
    owner_start[starts] = starts
    np.maximum.accumulate(owner_start, out=owner_start)
    place -= owner_start
    terms = code[raw]
    terms *= powers(int(place.max()) + 1, which)[place]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(terms, dtype=np.uint64, out=total[1:])
    return mix(total[ends] - total[starts] + length.astype(np.uint64))


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of every `size` consecutive entries; windows that cross rows are the caller's to drop.

    Prefix sums of entry * base**place; dividing by base**start makes equal windows equal anywhere.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words), which)[: len(words)], dtype=np.uint64, out=total[1:])
    inverse = powers(n, which + 2)[:n]
    return mix((total[size:] - total[:-size]) * inverse)


def windows_of_rows(first_word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the words of the slice) of the windows inside one row, and the row of each."""
    count = np.maximum(np.diff(first_word) - size + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    return np.arange(len(row)) - begin[row] + first_word[:-1][row], row


def covered(flags: np.ndarray, size: int, n: int) -> np.ndarray:
    """Words covered by the flagged window starts; flags has one entry for each word."""
    edge = np.zeros(n + size + 1, np.int32)
    at = np.flatnonzero(flags)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:n]) > 0
