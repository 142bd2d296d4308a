"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

Both tokenizers split a text into tokens of known bytes. Byte offsets where tokens of both end cut the tokens
into groups. Most groups hold one token of each, and stand in stretches in which the index of the B token is the
index of the A token plus a constant shift, a diagonal: there the arrays of token ends are compared at the
current shift by exponential probing (1, 2, 4, ... ends at once, then halves of the last step), and the stretch
is jumped as one. Where it breaks, the irregular group is walked token by token to the next common end, which
gives its links and the new shift.

A text is cut before encoding where one space or one line feed stands between two characters that are not white
space: the pattern of A begins a token there in any case, and no piece of B holds the space mark behind another
character or a line feed beside one (checked when the model is loaded). So these units are encoded alone, and as
both sides end with each unit, so are their groups. The units that a worker does not yet know are encoded and
aligned together, end to end, and remembered; a text is then the sequence of its units. A long text goes in
blocks of units.

How many documents hold a pair of ids linked is counted for each Arrow batch and summed by Spark. The most
frequent pairs, `FREQUENT` at most (so many numbers, whatever the corpus), are sent to all tasks; documents keep
their remaining pairs, which are joined with the counts in a shuffle. Both ways are exact.

Null and empty texts, and those whose token bytes of either side are not the text with a space before it, have no
tokens: zeros, and an empty string for the digest. Each row is a document of its own, repeated rows too; null ids
are kept; an empty table gives an empty result; only the id and the text column are read.
"""

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import scratch

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

#: Pairs that are sent to all tasks at most: 12 bytes each.
FREQUENT = 1 << 20
#: Units that a worker remembers at most, and units of a text that are handled at once.
REMEMBERED, BLOCK_UNITS = 1 << 19, 1 << 16
#: A pair of ids as one number: a * B_IDS + b. The product of both vocabularies must fit 32 bits.
B_IDS = 1 << 15
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LINE = re.compile(r"(?<=\S)(?=\n\S)")


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


def units_of(text: str) -> list[str]:
    """The text in units that both tokenizers encode alone.

    A space stands before each unit, but for those that begin with white space themselves.
    """
    units = _CUT.split(text)
    if units[0][:1].isspace():
        units[0] = " " + units[0]
    if "\n" in text:
        units = [part for u in units for part in (_LINE.split(u) if "\n" in u else (u,))]
    return units


def diagonal(ea: list[int], eb: list[int]) -> tuple[list[tuple[int, int, int, int, bool]], list[int], list[int]]:
    """Token ends of both sides -> parts, and the A and the B index of every link.

    A part (i0, i1, j0, j1, single) is a stretch of one-to-one groups, or else one group. Both lists end at the
    same offset.
    """
    parts, la, lb = [], [], []
    i = j = 0
    n = len(ea)
    while i < n:
        k, step = 0, 1
        while ea[i + k : i + k + step] == eb[j + k : j + k + step]:
            k += step
            if i + k >= n:
                k = n - i
                break
            step *= 2
        else:
            while step > 1:
                step //= 2
                if ea[i + k : i + k + step] == eb[j + k : j + k + step]:
                    k += step
        if k:
            parts.append((i, i + k, j, j + k, True))
            la.extend(range(i, i + k))
            lb.extend(range(j, j + k))
            i += k
            j += k
            if i >= n:
                break
        # an irregular group: walk to the next common end; the shift is then j - i
        i0, j0, x, y = i, j, ea[i], eb[j]
        la.append(i)
        lb.append(j)
        while x != y:
            if x < y:
                i += 1
                x = ea[i]
            else:
                j += 1
                y = eb[j]
            la.append(i)
            lb.append(j)
        i += 1
        j += 1
        parts.append((i0, i, j0, j, False))
    return parts, la, lb


class _Numbers:
    """A growing array."""

    def __init__(self, kind):
        self.room, self.size = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.room):
            self.room = np.concatenate((self.room[: self.size], np.zeros(max(self.size, len(values)), self.room.dtype)))
        self.room[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class Tokenizers:
    """Both tokenizers with the bytes of their tokens, and the units that are known."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        size = self.a.get_vocab_size()
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("a piece of B holds the space mark behind another character, or a line feed: texts cannot be cut before encoding")
        if len(pieces) > B_IDS or size * B_IDS > 1 << 32:
            raise ValueError("the vocabularies are too large for pairs of 32 bits")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id("▁")
        self.a_names, self.b_names = [str(i) for i in range(size)], [str(i) for i in range(len(pieces))]
        self.forget()

    def forget(self) -> None:
        """Units by number: groups as a string, tokens of A (-1: bytes not kept), of B, groups; their links end to end."""
        self.number: dict[str, int] = {}
        self.lines: list[str] = []
        self.counts = _Numbers("i8,i8,i8,i8")
        self.codes = _Numbers(np.uint32)

    def learn(self, units: list[str]) -> None:
        """Encodes and aligns units that are not known, end to end."""
        whole = [u if u[:1].isspace() else " " + u for u in units]
        found_a = self.a.encode_batch_fast(whole, add_special_tokens=False)
        # B puts a space before a text itself: a mark of its own where the unit begins with a line feed
        found_b = self.b.encode([u[1:] if u[0] == " " else u for u in whole], num_threads=1)
        a, b, wa, wb, size, of_a, of_b = [], [], [], [], [], [], []
        for u, x, y in zip(whole, found_a, found_b, strict=True):
            x = x.ids
            if u[0] != " " and y[:1] == [self.mark]:
                y = y[1:]
            raw = u.encode()
            bytes_a, bytes_b = [self.a_bytes[i] for i in x], [self.b_bytes[i] for i in y]
            good = b"".join(bytes_a) == raw == b"".join(bytes_b)
            size.append(len(raw) if good else 0)
            of_a.append(len(x) if good else -1)
            of_b.append(len(y) if good else 0)
            if good:
                a += x
                b += y
                wa += map(len, bytes_a)
                wb += map(len, bytes_b)
        ea, eb = np.cumsum(wa, dtype=np.int64), np.cumsum(wb, dtype=np.int64)
        parts, la, lb = diagonal(ea.tolist(), eb.tolist())
        sa, sb = [self.a_names[i] for i in a], [self.b_names[i] for i in b]
        lines, last = [], []
        for i0, i1, j0, j1, single in parts:
            if single:
                lines += [f"{x}|{y}" for x, y in zip(sa[i0:i1], sb[j0:j1], strict=True)]
                last += range(i0, i1)
            else:
                lines.append(f"{','.join(sa[i0:i1])}|{','.join(sb[j0:j1])}")
                last.append(i1 - 1)
        ends = np.cumsum(size)
        la, lb = np.array(la, np.int64), np.array(lb, np.int64)
        groups = np.searchsorted(ea[np.array(last, np.int64)], ends, "right") if len(ea) else np.zeros(len(ends), np.int64)
        links = np.searchsorted(ea[la], np.concatenate(([0], ends)), "right") if len(ea) else np.zeros(len(ends) + 1, np.int64)
        first = np.concatenate(([0], groups[:-1]))
        # a unit without tokens owns no group, as its end is that of the unit before it
        self.lines += [";".join(lines[x:y]) for x, y in zip(first.tolist(), groups.tolist(), strict=True)]
        rows = np.zeros(len(units), "i8,i8,i8,i8")
        rows["f0"], rows["f1"], rows["f2"], rows["f3"] = of_a, of_b, groups - first, links[1:] + self.codes.size
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units)), strict=True))
        self.counts.extend(rows)
        self.codes.extend(np.array(a, np.uint32)[la] * np.uint32(B_IDS) + np.array(b, np.uint32)[lb] if len(ea) else np.zeros(0, np.uint32))

    def numbers(self, units: list[str]) -> list[int]:
        """The units by number, the new ones learnt before."""
        if len(self.number) > REMEMBERED:
            self.forget()
        new = list(dict.fromkeys(u for u in units if u not in self.number))
        if new:
            self.learn(new)
        return [self.number[u] for u in units]


@lru_cache(maxsize=2)
def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


class Aligned:
    """What one text gives: numbers, a digest or the strings of its groups, and its links with their numbers."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.digest, self.groups = hashlib.sha256(), []
        self.codes, self.times = np.zeros(0, np.uint32), np.zeros(0, np.int64)


def align(text: str | None, both: Tokenizers, keep_groups: bool = False) -> Aligned:
    """Tokens, groups and links of one text, block by block."""
    out, pairs = Aligned(), []
    units = units_of(text) if text else []
    for at in range(0, len(units), BLOCK_UNITS):
        mine = both.numbers(units[at : at + BLOCK_UNITS])
        lines = ";".join([both.lines[k] for k in mine])
        if keep_groups:
            out.groups += lines.split(";")
        out.digest.update(lines.encode() if at == 0 else b";" + lines.encode())
        mine = np.array(mine)
        rows, ends = both.counts.values[mine], both.counts.values["f3"]
        if (rows["f0"] < 0).any():
            return Aligned()
        out.n_a += int(rows["f0"].sum())
        out.n_b += int(rows["f1"].sum())
        out.n_groups += int(rows["f2"].sum())
        begin = np.where(mine > 0, ends[mine - 1], 0)
        many = rows["f3"] - begin
        place = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        out.n_links += len(place)
        pairs.append(np.unique(both.codes.values[place], return_counts=True))
    if len(pairs) == 1:
        out.codes, out.times = pairs[0]
    elif pairs:
        out.codes, at = np.unique(np.concatenate([c for c, _ in pairs]), return_inverse=True)
        out.times = np.bincount(at, np.concatenate([t for _, t in pairs])).astype(np.int64)
    return out


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(id_col, pos, a array<int>, b array<int>): the groups of every text in order."""
    paths = _paths(a_path, b_path)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(*paths)
        kind = pa.list_(pa.int32())
        for batch in batches:
            for row in range(batch.num_rows):
                lines = align(batch.column(1)[row].as_py(), both, keep_groups=True).groups
                sides = [[[int(x) for x in side.split(",")] for side in line.split("|")] for line in lines]
                ident = batch.column(0).slice(row, 1).take(pa.array(np.zeros(len(lines), np.int64)))
                yield pa.RecordBatch.from_arrays([ident, pa.array(range(len(lines)), pa.int64()), pa.array([a for a, _ in sides], kind), pa.array([b for _, b in sides], kind)], [id_col, "pos", "a", "b"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(scan, f"`{id_col}` {kind}, pos long, a array<int>, b array<int>")


def _numbers(column: pa.Array, kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column end to end, and where each row begins (and a total)."""
    rows = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return (np.concatenate(rows) if rows else np.zeros(0, kind)), np.cumsum([0, *map(len, rows)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, n = np.unique(_numbers(batch.column(0))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])


def least_count(sizes: list[tuple[int, int]], most: int) -> int:
    """The smallest power of two so that at most `most` pairs have that count or a higher one.

    sizes: (bits of the count, pairs), the counts of b bits being those from 2**(b - 1) up to 2**b.
    """
    total = 0
    for bits, pairs in sorted(sizes, reverse=True):
        total += pairs
        if total > most:
            return 1 << bits
    return 1


def pair_alignment(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, frequent: int = FREQUENT
) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark = df.sparkSession
    paths = _paths(a_path, b_path)
    kind = df.schema[id_col].dataType.simpleString()
    columns = ["n_a", "n_b", "n_groups", "n_links"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(*paths)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = [align(t.as_py(), both) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([getattr(f, c) for f in found], pa.int64()) for c in columns], pa.array([f.digest.hexdigest() if f.n_a else "" for f in found]),
                     pa.array([f.codes.astype("<u4").tobytes() for f in found], pa.binary()), pa.array([f.times.astype("<u4").tobytes() for f in found], pa.binary())],
                    ["id", *columns, "groups_sha256", "codes", "times"],
                )

    ddl = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch(spark, texts.mapInArrow(scan, f"{ddl}, codes binary, times binary").withColumn("row", F.monotonically_increasing_id()), "align-rows")

    counts = rows.select("codes").mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("code", 15))
    counts = scratch(spark, counts, "align-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("top"))
    table = scratch(spark, counts.join(highest, "a").select("code", "n", (F.col("n") == F.col("top")).cast("long").alias("best")), "align-table")
    sizes = [(r.bits, r.pairs) for r in table.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("pairs")).collect()]  # 63 rows at most
    known = table.where(F.col("n") >= least_count(sizes, frequent)).toPandas().sort_values("code")  # `frequent` rows at most
    sent = spark.sparkContext.broadcast((known["code"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(np.int8)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = sent.value
        for batch in batches:
            names = batch.schema.names
            (mine, begin), (times, _) = (_numbers(batch.column(names.index(c))) for c in ("codes", "times"))
            mine, times = mine.astype(np.int64), times.astype(np.int64)
            at = np.minimum(np.searchsorted(code, mine), max(0, len(code) - 1))
            hit = code[at] == mine if len(code) else np.zeros(len(mine), bool)
            gain, good = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
            gain[hit], good[hit] = n[at[hit]] * times[hit], best[at[hit]] * times[hit]
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[begin]) for x in (good, gain)]
            rest = np.flatnonzero(~hit)
            lists = pa.array(np.searchsorted(rest, begin), pa.int32())
            rare = pa.ListArray.from_arrays(lists, pa.StructArray.from_arrays([pa.array(mine[rest]), pa.array(times[rest])], ["code", "times"]))
            kept = [batch.column(names.index(c)) for c in ("row", "id", *columns, "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums), rare], ["row", "id", *columns, "groups_sha256", "n_best", "count_sum", "rare"])

    known_part = scratch(spark, rows.mapInArrow(look_up, f"row long, {ddl}, n_best long, count_sum long, rare array<struct<code:long,times:long>>"), "align-known")
    rare = known_part.select("row", F.explode("rare").alias("r")).select("row", "r.code", "r.times").join(table, "code")
    rare = rare.groupBy("row").agg(F.sum(F.col("best") * F.col("times")).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return known_part.join(rare, "row", "left").select(
        F.col("id").alias(id_col), *columns, (F.col("n_best") + zero("more_best")).alias("n_best"), (F.col("count_sum") + zero("more_sum")).alias("count_sum"), "groups_sha256"
    )


def op13_diagonal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers' alignment over every document, with the counts of its pairs over all documents."""
    found = pair_alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
