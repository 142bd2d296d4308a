import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import quality_classifier as c


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(40_000) < 0.7
    right = [0.95, 0.9, 0.8, 0.7, 0.85, 0.6, 0.9, 0.75]
    vote = np.stack([np.where(rng.random(len(truth)) < 0.2, c.NO_VOTE, np.where((rng.random(len(truth)) < r) == truth, c.GOOD, c.BAD)) for r in right], axis=1)
    patterns, n = np.unique(c.pattern_of(vote), return_counts=True)
    good, table, share = c.estimate(patterns, n)
    assert share == pytest.approx(0.7, abs=0.02)
    assert list(c.accuracies(table, share).values()) == pytest.approx(right, abs=0.03)


def test_measures_against_plain_python():
    texts = ["One two. three\nOne two. three\nx", "", None, "a ## b", "été été été été", " \n"]
    got = {}
    for first, _, values, _, _ in c.measures(pa.array(texts)):
        for name, x in values.items():
            got.setdefault(name, []).extend(x.tolist())
    assert got["words"] == [7, 0, 0, 3, 4, 0]
    assert got["word_length"] == pytest.approx([25 / 7, 0, 0, 4 / 3, 3, 0])
    assert got["symbols"] == pytest.approx([0, 0, 0, 2 / 3, 0, 0])
    assert got["repeated_lines"] == pytest.approx([1 / 3, 0, 0, 0, 0, 0])
    assert got["repeated_windows"] == pytest.approx([6 / 7, 0, 0, 0, 1, 0])
    assert got["with_letters"] == pytest.approx([1, 0, 0, 2 / 3, 1, 0])
    assert got["distinct_words"] == pytest.approx([4 / 7, 0, 0, 1, 1 / 4, 0])
    assert got["sentence_ends"] == pytest.approx([2 / 7, 0, 0, 0, 0, 0])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = c.op9_weak_label_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good, bad = scored[scored.quality == 1], scored[scored.quality == 0]
    long = good[good.score.notna()]
    assert bad.kept.mean() < 0.05
    assert long.kept.mean() > 0.95


def test_edge_rows(spark):
    rows = [(1, None), (1, ""), (2, "plain words of a sentence here. " * 30), (2, "plain words of a sentence here. " * 30), (None, "| # |" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as kept")
    got = c.score(df, c.train(df)).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 2}) == 1
    empty = df.limit(0)
    assert c.score(empty, c.train(empty)).count() == 0


def test_copies_do_not_reach_the_driver(spark, monkeypatch):
    rows = [(i, None) for i in range(500)] + [(i, "the same plain words of a sentence here. " * 30) for i in range(500)] + [(0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    collected, whole = [], type(df).toPandas
    monkeypatch.setattr(type(df), "toPandas", lambda self: collected.append(whole(self)) or collected[-1])
    c.train(df)
    assert [len(x) for x in collected if "key" in x.columns] == [2]
