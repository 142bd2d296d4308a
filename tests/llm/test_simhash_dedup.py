"""Fingerprints and components against a plain version over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash_dedup as s

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = [w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(x, seed=42).intdigest() for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, fingerprint); a component is named by its smallest id."""
    name = list(range(len(rows)))

    def root(i):
        while name[i] != i:
            name[i] = name[name[i]]
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                name[root(i)] = root(j)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[root(i)] = min(ident, least.get(root(i), ident))
    return [least.get(root(i)) for i in range(len(rows))]


def test_fingerprint_of_every_document_as_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = s.op11_simhash_positions(spark, SF).collect()
    rows = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert sorted(rows) == sorted((i, plain_fingerprint(t)) for i, t in texts.items())
    assert [r.component_id for r in got] == plain_components(rows)


@pytest.mark.parametrize("text", ["", "  \t\n", "one", "One two", "one TWO three", "é É ß İ x y z", "\x1c a\x0bb", "a " * 50, "x " * 3 + "\xa0 y"])
def test_fingerprint_of_odd_texts(text):
    assert s.fingerprint(text.encode()) == plain_fingerprint(text)


def test_spark_hashes_a_short_text_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] % 2**64 == s.fingerprint(b"One two three")


def test_long_texts_go_in_passes(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)).encode()
    whole = s.fingerprint(text)
    monkeypatch.setattr(s, "PASS", 64)
    assert s.fingerprint(text) == whole


@pytest.mark.parametrize("limit", [1, 2, 7, s.LIST_LIMIT])
def test_links_connect_what_all_pairs_connect(spark, limit):
    draw = random.Random(5)
    centres = [draw.getrandbits(64) for _ in range(6)]
    members = {c ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))) for c in centres for _ in range(40)}
    members |= {draw.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1, 1, 2**63}
    rows = [(i, x) for i, x in enumerate(sorted(members))]
    fps = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for _, x in rows], "fp long")
    found = {(r.a % 2**64, r.b % 2**64) for r in s.links(fps, list_limit=limit).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    number = {x: i for i, x in rows}
    name = list(range(len(rows)))
    for _ in range(len(rows)):
        before = list(name)
        for a, b in found:
            name[number[a]] = name[number[b]] = min(name[number[a]], name[number[b]])
        if name == before:
            break
    assert name == plain_components(rows)


def test_nulls_empty_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "same words here now", "x"), (7, "same words here now", "x"), (7, "same words here now", "x"), (9, "quite another text", None), (None, "lonely words of a row without id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumns({"key": F.lit(1), "least": F.lit(2), "component_id": F.lit(3)})
    got = sorted(((r.doc_id, r.component_id) for r in s.near_classes(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 7), (7, 7), (7, 7), (9, 9), (None, None)], key=str)
    assert s.near_classes(df.limit(0)).count() == 0


def test_a_large_group_of_copies_is_one_entry(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "copied text of many rows").otherwise(F.concat(F.lit("own text number "), F.col("id"))).alias("text"))
    got = s.near_classes(df)
    assert got.where("doc_id < 2000 and component_id = 0").count() == 2000
