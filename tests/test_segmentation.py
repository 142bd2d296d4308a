"""A planted lexicon is learnt, and paths are the best of all."""

import math
import random
from itertools import combinations

from tidemark.operators import gram_index, segmentation

LETTERS = [chr(0x4E00 + 7 * i) for i in range(60)]


def corpus(seed=1):
    draw = random.Random(seed)
    words = list({"".join(draw.sample(LETTERS, draw.choice([2, 2, 2, 3, 4]))) for _ in range(60)})
    texts, cuts = [], []
    for _ in range(300):
        said = [draw.choice(words) for _ in range(draw.randint(3, 14))]
        texts.append("".join(said))
        cuts.append(said)
    return words, texts, cuts


def boundaries(words):
    at, out = 0, set()
    for w in words:
        at += len(w)
        out.add(at)
    return out - {at}


def test_a_planted_lexicon_is_learnt(spark):
    words, texts, cuts = corpus()
    df = spark.createDataFrame([(t + "。Valve3 " + t,) for t in texts] + [(None,), ("",)], "t string")
    found = segmentation.lexicon(df, "t")
    rows = {r.word: r for r in found.collect()}
    assert len(set(words) & set(rows)) >= 0.95 * len(words)
    cutter = segmentation.segmenter(found)
    hit = made = true = 0
    for text, said in zip(texts, cuts, strict=True):
        a, b = boundaries(cutter.cut(text)), boundaries(said)
        hit, made, true = hit + len(a & b), made + len(a), true + len(b)
    assert hit / made >= 0.9 and hit / true >= 0.9
    some = next(iter(rows))
    assert rows[some].n == 2 * sum(t.count(some) for t in texts)  # words of these texts do not overlap themselves
    row = df.limit(1).select(segmentation.or_query(df.t, cutter).alias("w")).first().w
    assert "valve3" in row.split(" OR ") and all(len(w) > 1 for w in row.split(" OR "))


def test_cohesion_and_entropy_as_counted_by_hand(spark):
    texts = ["天地天地人", "人天地", "天地", "地天地人"] * 3
    rows = {r.word: r for r in segmentation.lexicon(spark.createDataFrame([(t,) for t in texts], "t string"), "t", least_count=2, cohesion=-9, entropy=-1).collect()}
    n, total = 15, sum(map(len, texts))
    assert rows["天地"].n == n and math.isclose(rows["天地"].cohesion, math.log(n * total / (15 * 18)))
    # left of it: 6 ends of a run, 3 times 地, 3 times 人, and 3 ends more: each end by itself
    left = {"地": 6, "人": 3}
    h = math.log(n) - sum(v * math.log(v) for v in left.values()) / n
    right = {"天": 3, "人": 6}
    g = math.log(n) - sum(v * math.log(v) for v in right.values()) / n
    assert math.isclose(rows["天地"].entropy, min(h, g))


def test_best_path_is_the_best_of_all_paths():
    draw = random.Random(2)
    for _ in range(60):
        letters = LETTERS[:4]
        words = {"".join(draw.choice(letters) for _ in range(draw.randint(1, 3))): draw.randint(1, 50) for _ in range(12)}
        cutter = segmentation.Segmenter(words)
        total = sum(words.values()) + 1
        run = "".join(draw.choice(letters) for _ in range(8))

        def score(path, words=words, total=total, cutter=cutter):
            parts = [math.log(words[w] / total) if w in words else cutter.alone if len(w) == 1 else -math.inf for w in path]
            return sum(parts)

        paths = [[run[a:b] for a, b in zip([0, *cut], [*cut, len(run)], strict=True)] for r in range(len(run)) for cut in combinations(range(1, len(run)), r)]
        assert math.isclose(score(cutter.cut(run)), max(map(score, paths)))


def test_search_by_segmented_words(spark):
    cutter = segmentation.Segmenter({"管道": 9, "巡线": 7, "应急": 5})
    index = gram_index.build(spark.createDataFrame([("c1", "管道运行"), ("c2", "应急预案"), ("c3", "其他")], "k string, t string"), "k", "t")
    queries = spark.createDataFrame([(1, "管道巡线员"), (2, "应急"), (3, None), (4, "")], "q int, t string")
    got = [(r.q, r.k) for r in segmentation.segmented_search(queries, index, "q", "t", "k", 3, cutter).orderBy("q").collect()]
    assert got == [(1, "c1"), (2, "c2")]


def test_empty_table(spark):
    assert segmentation.lexicon(spark.createDataFrame([], "t string"), "t").count() == 0
    assert segmentation.Segmenter({}).tokens("管道 a1") == ["管", "道", "a1"]
