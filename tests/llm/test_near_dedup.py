import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import near_dedup as n
from tidemark.llm._components import components


def partition(pairs):
    groups = collections.defaultdict(set)
    for node, root in pairs:
        groups[root].add(node)
    return {frozenset(g) for g in groups.values()}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(500, i) for i in range(501, 700)] + [(i, i + 1) for i in range(800, 860)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    got = partition((r.node, r.root) for r in components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert got == partition((x, find(x)) for x in list(parent))
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_samples_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    weight = rng.uniform(0.5, 9, 300).astype(np.float32)
    other = weight.copy()
    other[:60] *= 3
    want = np.minimum(weight, other).sum() / np.maximum(weight, other).sum()
    rows_before, n.ROWS = n.ROWS, 1
    seeds = n._SEEDS
    try:
        agree = 0
        for k in range(40):
            n._SEEDS = seeds[:20] + np.uint64(7919 * k)
            keys = n.signatures(2, np.repeat([0, 1], 300), np.tile(hashes, 2), np.concatenate([weight, other]))
            agree += (keys[0] == keys[1]).sum()
    finally:
        n.ROWS, n._SEEDS = rows_before, seeds
    assert agree / 800 == pytest.approx(want, abs=0.06)


def brute(rows, idf, threshold=0.8):
    texts = sorted({t or "" for _, t in rows})
    sets = []
    for _, last_, row, value, weight in n.weighted_sets(pa.array(texts), idf):
        for k in range(last_ - _):
            pick = row == k
            sets.append(dict(zip(value[pick].tolist(), weight[pick].tolist(), strict=True)))
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            low = sum(min(w, b[h]) for h, w in a.items() if h in b)
            high = sum(a.values()) + sum(b.values()) - low
            if high and low / high >= threshold:
                parent[find(i)] = find(j)
    at = {t: k for k, t in enumerate(texts)}
    return partition(((i, t or ""), find(at[t or ""])) for i, t in rows)


def near_copies(rng):
    rows, base = [], [f"w{rng.randint(0, 900)}" for _ in range(120)]
    for i in range(90):  # one group with edits of every size
        words = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8, 30])):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"w{rng.randint(0, 900)}" for _ in range(rng.randint(1, 200)))) for i in range(60)]
    return rows + [(200, None), (201, ""), (202, "a b"), (203, "a b"), (204, "a b c"), (204, "a b c"), (None, rows[0][1]), (205, "x " * 20_000)]


@pytest.mark.parametrize("block", [256, 7])
def test_classes_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", block)
    rows = near_copies(random.Random(9))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as digest")
    idf = n._idf(df.selectExpr("coalesce(text, '') as text"))
    got = n.classes(df).collect()
    text = {r: t or "" for r, t in rows}
    assert len(got) == len(rows)
    assert partition(((r.id, text[r.id]), r.root) for r in got) == brute(rows, idf)
    kept = n.first_of_each(df)
    assert kept.columns == df.columns
    assert kept.distinct().count() == len({r.root for r in got})


def test_generated_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = partition((r.doc_id, r.class_id) for r in n.op4_weighted_minhash(spark, "/root/testdata/sf0.01").collect())
    want = brute(rows, n._idf(df.select("text")))
    assert got == {frozenset(i for i, _ in g) for g in want}


def test_empty_table(spark):
    assert n.near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
