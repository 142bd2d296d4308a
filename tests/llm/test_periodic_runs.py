"""Runs against a plain version that tries every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _common
from tidemark.llm import periodic_runs as p

SF = "/root/testdata/sf0.001"


def words_of(text):
    return [w for w in (text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]


def plain_runs(words):
    """(start, length, period) by start, then period."""
    n, least = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                least.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def plain_left(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_planted(doc_id, text):
    words = words_of(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % period] for i, w in enumerate(words)]
    return words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_as_a_plain_version(spark):
    got = {r.doc_id: r for r in p.op12_scale_tiles(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = plain_planted(doc_id, text)
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        milli = best[1] and 1000 * best[1] // best[2]
        expected = (doc_id, len(runs), best[0], best[1], best[2], milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(plain_left(words, runs)))
        assert tuple(got[doc_id]) == expected


def some_words(draw, n):
    base = [f"w{draw.randrange(3)}" for _ in range(max(1, n // draw.randint(1, 12)))]
    words = (base * (n // len(base) + 1))[:n]
    for _ in range(draw.randint(0, 3)):
        words[draw.randrange(n)] = f"w{draw.randrange(3)}"
    return words


@pytest.mark.parametrize("low, core", [(1, 8), (3, 16), (2, 64)])
def test_tiles_of_long_texts_give_what_the_whole_gives(spark, low, core):
    draw = random.Random(low)
    texts = [" ".join(some_words(draw, draw.choice([30, 100, 333, 700]))) for _ in range(40)] + ["a " * 500, "a b " * 300 + "c", " ".join(map(str, range(400)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for long_chars in (50, 10**6):
        for r in p.periodic_runs(df, long_chars=long_chars, low=low, core=core).collect():
            words = texts[r.doc_id].split()
            runs = plain_runs(words)
            assert [(x.start, x.length, x.period) for x in r.runs] == runs
            assert r.collapsed_sha256 == sha(plain_left(words, runs))
            assert r.collapsed is None or r.collapsed == plain_left(words, runs)


def test_a_self_similar_text_does_not_cheat_the_hashes():
    sequence = np.array([bin(i).count("1") % 2 for i in range(1 << 13)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(5)
    found = p.batch_fragments(sequence, np.array([0, len(sequence)]))[0]
    assert all(np.array_equal(sequence[a:b], sequence[a + q : b + q]) for q, a, b in found)
    assert not [1 for q, a, b in found if b - a + q >= max(6, 4 * q)]  # this sequence has no word four times in a row


def test_tiles_cover_every_boundary_once():
    for n in (6, 100, 5000, 70_000):
        seen = {}
        for k0, k1, b0, b1, start, end in p.tiles(n, 4, 256):
            for k in range(k0, k1):
                for b in range(-(-b0 // (2 << k)) * (2 << k), b1, 2 << k):
                    seen[k, b] = seen.get((k, b), 0) + 1
                    assert start <= max(0, b - (2 << k)) and end >= min(n, b + (4 << k))
        octaves = {k for k, _ in seen}
        assert set(seen.values()) == {1} and octaves == {k for k in range(40) if max(6, 4 << k) <= n}
        assert all(len([1 for k2, _ in seen if k2 == k]) == -(-n // (2 << k)) for k in octaves)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    raw = np.frombuffer(" ".join(f"word{i % 91}" * (1 + i % 5) for i in range(3000)).encode(), np.uint8)
    starts, ends, _ = _common.word_bounds(raw, np.array([0, len(raw)]))
    whole = _common.word_hashes(raw, starts, ends)
    monkeypatch.setattr(_common, "SLICE_BYTES", 100)
    assert np.array_equal(whole, _common.word_hashes(raw, starts, ends))


def test_nulls_empty_repeats_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (None, "x x x x x x x"), (5, "x x x x x x x"), (5, "x x x x x x x"), (6, "x x x x x"), (7, "é ü é ü é ü é ü")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "runs": F.lit(2), "q": F.lit(3), "id": F.lit(4)})
    got = sorted(((r.doc_id, [(x.start, x.length, x.period) for x in r.runs], r.collapsed_sha256) for r in p.periodic_runs(df).collect()), key=str)
    none, one = [], [(0, 7, 1)]
    expected = [(1, none, sha("")), (2, none, sha("")), (3, none, sha("")), (4, none, sha("a b")), (None, one, sha("x")), (5, one, sha("x")), (5, one, sha("x")), (6, none, sha("x x x x x")), (7, [(0, 8, 2)], sha("é ü"))]
    assert got == sorted(expected, key=str)
    assert p.periodic_runs(df.limit(0)).count() == 0


def test_a_large_group_of_copies(spark):
    df = spark.range(2500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "la la la la la la").otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"))
    got = p.periodic_runs(df)
    assert got.where("size(runs) = 1").count() == 2000 and got.count() == 2500
