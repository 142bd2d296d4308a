import collections
import hashlib
import random
import re

import pytest

from tidemark.llm import substring_dedup as s

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = collections.Counter(tuple(w[k : k + size]) for _, w in docs for k in range(len(w) - size + 1))
    out = []
    for i, w in docs:
        gone = {k + o for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] > 1 for o in range(size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


def corpus(rng, size):
    passage = [f"p{k}" for k in range(3 * size)]
    rows = []
    for i in range(60):
        words = [rng.choice(["x", "y", "zé"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(0, 5 * size))]
        for _ in range(rng.randint(0, 2)):
            a, n = rng.randint(0, size), rng.choice([size // 2, size - 1, size, size + 1, 2 * size])
            at = rng.randint(0, len(words))
            words[at:at] = passage[a : a + n]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows + [(90, None), (91, ""), (92, " \n"), (93, "same " * 300), (94, rows[5][1]), (94, rows[5][1]), (None, rows[7][1])]


@pytest.mark.parametrize("size", [5, 8, 35])
def test_against_brute_force(spark, size):
    rows = corpus(random.Random(size), size)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as grp", "2 as id")
    got = collections.Counter(map(tuple, s.repeat_digest(df, size=size).collect()))
    assert got == brute(rows, size)


def test_generated_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = collections.Counter(map(tuple, s.op8_fixed_block_anchors(spark, "/root/testdata/sf0.01").collect()))
    assert got == brute(rows, 35)


def test_kept_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "z a b c q")], "k long, body string")
    assert {r.k: r.body if "body" in r else r.text for r in s.without_repeats(df, "k", "body", size=3).collect()} == {1: "d e", 2: "z q"}
    assert s.repeat_digest(df.limit(0), "k", "body").count() == 0
