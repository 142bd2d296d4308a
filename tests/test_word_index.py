"""Pruned ranking against the plain plan that scores every document."""

import random

import numpy as np
import pyarrow as pa

from tidemark.operators import search, word_index


def rows_of(df):
    return sorted((r[0], r[1], r.score, r["rank"]) for r in df.collect())


def test_pruned_ranking_as_the_plain_plan(spark):
    draw = random.Random(1)
    common, rare = ["the", "of", "and", "pipe"], [f"rare{i}" for i in range(60)]
    docs = [(f"d{i:04d}", " ".join(draw.choice(common if draw.random() < 0.8 else rare) for _ in range(draw.randint(0, 60)))) for i in range(400)] + [("d9", None), (None, "rare1"), ("d8", "")]
    queries = [(f"q{i}", " ".join(draw.sample(rare, 2) + draw.sample(common, 2)) + " The") for i in range(20)] + [("q90", None), ("q91", ""), ("q92", "unknown words"), (None, "the")]
    df = spark.createDataFrame(docs, "k string, t string").where("k is not null and t is not null")
    asked = spark.createDataFrame(queries, "q string, t string")
    expected = rows_of(search.bm25(asked.where("q is not null"), df, "q", "t", "k", "t", 5))
    index = word_index.build(spark.createDataFrame(docs, "k string, t string"), "k", "t", segment_chars=9000, block=8)
    assert index.rows.select("seg").distinct().count() > 1
    assert rows_of(word_index.topk(asked, index, "q", "t", "k", 5, block=8)) == expected
    again = word_index.reopened(spark, index.path)
    assert rows_of(word_index.topk(asked.limit(3), again, "q", "t", "k", 5, block=8)) == [r for r in expected if r[0] in ("q0", "q1", "q2")]


def test_blocks_below_the_kth_score_are_skipped(spark):
    draw = np.random.default_rng(3)
    n = 6400
    common = (1.0, np.arange(n), 0.5 + 0.1 * draw.random(n))
    at = np.sort(draw.choice(n, 40, replace=False))
    rare = (6.0, at, 1.0 + draw.random(40))
    lists = []
    for idf, places, gains in (common, rare):
        blocks = np.unique(places // 32)
        lists.append((idf, places, gains, blocks, np.array([gains[places // 32 == b].max() for b in blocks])))
    found, scores, scored = word_index.best_places(lists, 10)
    total = common[2].copy()
    total[at] += 6.0 * rare[2]
    order = np.lexsort((np.arange(n), -np.round(total, 6)))[:10]
    assert found.tolist() == order.tolist() and np.allclose(scores, total[order], atol=1e-6)
    assert scored < 0.25 * n


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, t string")
    index = word_index.build(none, "k", "t")
    queries = spark.createDataFrame([("q", "word")], "q string, t string")
    assert word_index.topk(queries, index, "q", "t", "k", 3).count() == 0
    assert word_index.topk(queries.limit(0), index, "q", "t", "k", 3).count() == 0


def test_lists_of_several_passes(monkeypatch):
    monkeypatch.setattr(word_index, "PASS_ENTRIES", 7)
    draw = random.Random(8)
    docs = [(i // 12, i % 12, [(w, draw.randint(1, 4)) for w in draw.sample("abcdef", draw.randint(0, 6))]) for i in range(36)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([d[0] for d in docs], pa.int32()), pa.array([d[1] for d in docs], pa.int32()), pa.array([sum(n for _, n in d[2]) for d in docs], pa.int32()),
         pa.array([[w for w, _ in d[2]] for d in docs], pa.list_(pa.string())), pa.array([[n for _, n in d[2]] for d in docs], pa.list_(pa.int32()))],
        ["seg", "place", "len", "words", "times"],
    )
    out = [r for b in word_index._lists(5.0, 4)(iter([batch.slice(0, 7), batch.slice(7, 0), batch.slice(7)])) for r in b.to_pylist()]
    assert len(out) > 18 and all(r["n"] == len(r["places"]) == len(r["gains"]) for r in out)
    found = {}
    for r in out:
        found.setdefault((r["word"], r["seg"]), []).extend(zip(r["places"], r["gains"]))
        tops = {}
        for p, g in zip(r["places"], r["gains"]):
            tops[p // 4] = max(g, tops.get(p // 4, 0))
        assert dict(zip(r["blocks"], r["tops"])) == tops
    expected = {}
    for seg, place, words in docs:
        for w, n in words:
            expected.setdefault((w, seg), []).append((place, n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(x for _, x in words) / 5))))
    assert found.keys() == expected.keys()
    for name, some in expected.items():
        assert [p for p, _ in some] == [p for p, _ in found[name]] and np.allclose([g for _, g in some], [g for _, g in found[name]])
