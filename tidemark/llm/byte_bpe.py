"""Byte-level BPE encoding and decoding.

Texts of up to `chunk_chars` code points are encoded as they are. A longer one is cut into chunks that
overlap; the chunks are pre-tokenised in parallel, and neighbours are stitched at the first pre-token
boundary of their overlap that both have: from a common boundary on, the pre-tokeniser, which goes from
left to right without memory, finds the same boundaries. Only boundaries behind a character that is not
white space count, because the rule for white space looks at the character after it. The pieces between
the stitches are then encoded, again in parallel, and the ids joined in order. A chunk whose overlap has
no common boundary (one word of hundreds of characters) is joined with what follows it before encoding,
so the ids are always those of the whole text.

Null text is the empty text: no ids. Repeated rows each have their own result; only the id and the text
column are read, so other columns cannot clash.
"""

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import scratch

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: The pre-tokeniser looks one character beyond a match, and white-space runs may end in the overlap.
MARGIN_CHARS = 32


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _decimals(path: str, pattern: str) -> list[str]:
    return [str(i) for i in range(_encoder(path, pattern).max_token_value + 1)]


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens that close with a character other than white space."""
    return [m.end() for m in regex.compile(pattern).finditer(text) if not m[0][-1].isspace()]


def cut_points(chunks: list[tuple[int, list[int], list[int]]]) -> list[int | None]:
    """For chunks of (start, boundaries in the head, boundaries in the tail), in order: where each one
    after the first takes over, or None if it never meets its predecessor, nor any after it."""
    cuts: list[int | None] = []
    for (_, _, tail), (_, head, _) in zip(chunks, chunks[1:], strict=False):
        common = sorted(set(tail) & set(head)) if not cuts or cuts[-1] is not None else []
        cuts.append(common[0] if common else None)
    return cuts


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """(id_col, ids binary): the token ids of each text as little-endian 32-bit integers."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()

    def pack(ids) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                ids = [pack(enc.encode_ordinary(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, ident, text = (batch.column(i).slice(row, 1) for i in range(3))
                text = text[0].as_py()
                starts = list(range(0, max(1, len(text) - overlap_chars), chunk_chars))
                ends = [*[s + chunk_chars + overlap_chars for s in starts[:-1]], len(text)]
                n = len(starts)
                take = pa.array(np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [key.take(take), ident.take(take), pa.array(range(n), pa.int64()), pa.array(starts, pa.int64()),
                     pa.array([text[a:b] for a, b in zip(starts, ends, strict=True)], pa.string())],
                    ["row", "id", "i", "start", "text"],
                )

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for start, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                at = boundaries(text, pattern)
                trusted = len(text) - MARGIN_CHARS
                heads.append([start + b for b in at if b < overlap_chars])
                tails.append([start + b for b in at if chunk_chars <= b < trusted])
            more = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "head", "tail"])

    def stitch(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        cuts = cut_points(list(zip(group.start, group["head"], group["tail"], strict=True)))
        begins = [0, *[s if c is None else c for c, s in zip(cuts, group.start[1:], strict=True)]]
        ends = [*begins[1:], -1]
        # a chunk that joins the next, or was joined, waits for the text around it
        waits = [*[c is None for c in cuts], False]
        waits = [w or (k > 0 and cuts[k - 1] is None) for k, w in enumerate(waits)]
        return pd.DataFrame({"row": group.row, "i": group.i, "from": begins, "to": ends, "waits": waits})

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern)
        for batch in batches:
            x = batch.to_pydict()
            ids, rest = [], []
            for text, start, begin, end, waits in zip(x["text"], x["start"], x["from"], x["to"], x["waits"], strict=True):
                piece = text[begin - start : None if end < 0 else end - start]
                ids.append(None if waits else pack(enc.encode_ordinary(piece)))
                rest.append(piece if waits else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.binary()), pa.array(rest, pa.string())],
                ["row", "id", "i", "ids", "rest"],
            )

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        enc = _encoder(path, pattern)
        parts, waiting = [], []
        for ids, rest in group.sort_values("i")[["ids", "rest"]].itertuples(index=False):
            if rest is not None:
                waiting.append(rest)
                continue
            if waiting:
                parts.append(pack(enc.encode_ordinary("".join(waiting))))
                waiting = []
            parts.append(ids)
        if waiting:
            parts.append(pack(enc.encode_ordinary("".join(waiting))))
        return pd.DataFrame({"id": group["id"].iloc[:1], "ids": [b"".join(parts)]})

    short = docs.where(F.length("text") <= chunk_chars).mapInArrow(whole, f"id {id_type}, ids binary")
    long = docs.where(F.length("text") > chunk_chars).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    chunk_ddl = f"row long, id {id_type}, i long, start long, text string"
    chunks = scratch(
        df.sparkSession,
        long.mapInArrow(cut, chunk_ddl)
        .repartition("row", "i")
        .mapInArrow(pretokenise, f"{chunk_ddl}, head array<long>, tail array<long>"),
        "bpe-chunks",
    )
    cuts = (
        chunks.select("row", "i", "start", "head", "tail")
        .groupBy("row")
        .applyInPandas(stitch, "row long, i long, `from` long, to long, waits boolean")
    )
    pieces = (
        chunks.select("row", "id", "i", "start", "text")
        .join(cuts, ["row", "i"])
        .select("row", "id", "i", "text", "start", "from", "to", "waits")
        .mapInArrow(encode_pieces, f"row long, id {id_type}, i long, ids binary, rest string")
    )
    joined = pieces.groupBy("row").applyInPandas(join, f"id {id_type}, ids binary")
    return short.unionByName(joined).withColumnRenamed("id", id_col)


def decode(
    df: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), ranks_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """The `keep` columns and `bytes`: the bytes of the tokens, one after the other. Null ids stay null."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    @F.pandas_udf("binary")
    def concat(ids: pd.Series) -> pd.Series:
        enc = _encoder(path, pattern)
        return ids.map(lambda x: None if x is None else enc.decode_bytes(np.frombuffer(x, "<u4").tolist()))

    return df.select(*keep, concat(F.col(ids_col)).alias("bytes"))


def encoding_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    path = options.get("ranks_path") or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = options.get("pattern", public_tokenizers.PATTERN)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, names = _encoder(path, pattern), _decimals(path, pattern)
        for batch in batches:
            counts, ids_sha, bytes_sha = [], [], []
            for packed in batch.column(1):
                ids = np.frombuffer(packed.as_buffer(), "<u4").tolist()
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(bytes_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    ids = encode(df, id_col, text_col, **options).select(F.col(id_col).cast("long").alias("doc_id"), "ids")
    return ids.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`, encoded and decoded."""
    return encoding_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
