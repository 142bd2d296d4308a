import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import byte_bpe as b


@pytest.fixture(scope="module")
def reference():
    lines = map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))
    ranks = {base64.b64decode(t): int(r) for t, r in lines}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    bits = ["the", " ", "  ", "\n", "\t", "isn't", "12345", "éàß", "日本語", "!!", "...", "a" * 70, " " * 40, "<|endoftext|>", "　", "🙂"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    return ["", None, "x", " ", "a" * 5000, " " * 3000, "ab " * 1500, "1" * 700 + " z" * 400, *made]


def test_chunked_encoding_equals_whole_text(spark, reference):
    rows = list(enumerate(texts())) + [(3, texts()[6]), (3, texts()[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as i", "2 as ids", "'x' as start")
    got = b.encoding_digest(df, chunk_chars=256, overlap_chars=96).collect()
    want = sorted(
        (
            i,
            len(ids := reference.encode_ordinary(t or "")),
            hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((t or "").encode()).hexdigest(),
        )
        for i, t in rows
    )
    assert sorted(map(tuple, got)) == want


def test_pieces_are_really_cut(spark):
    text = "some words here " * 200
    chunks, at = [], 0
    while at < len(text):
        piece = text[at : at + 300]
        found = b.boundaries(piece, public_tokenizers.PATTERN)
        chunks.append((at, [at + x for x in found if x < 44], [at + x for x in found if 256 <= x < len(piece) - 8]))
        at += 256
    cuts = b.cut_points(chunks[:-1])
    assert all(c is not None for c in cuts)


def test_decode_restores_bytes(spark, reference):
    ids = np.asarray(reference.encode_ordinary("née 12 ok"), "<u4").tobytes()
    df = spark.createDataFrame([(1, bytearray(ids)), (2, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.bytes for r in b.decode(df).collect()}
    assert bytes(got[1]).decode() == "née 12 ok" and got[2] is None


def test_empty_table(spark):
    assert b.encoding_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
