import collections
import random
import re

from tidemark.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = collections.Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if seen[w] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (
        n, sum(map(len, words)), sum(text.count(c) for c in q.SYMBOLS), len(lines) - len(set(lines)), len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


def texts():
    rng = random.Random(3)
    bits = ["a", "b", "word", "naïve", "##", "a|b", "\n", "\n\n", "\t", "日本", "🙂", " x"]
    made = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 160))) for _ in range(80)]
    return [None, "", " \n ", "one", "one two", "a a a", "a a a a", "same line\nsame line\n", " ", *made, "w " * 30_000]


def test_counts_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(7, "a a a"), (None, "x y")]
    df = spark.createDataFrame([(i, t, None if i == 3 else "en", None, 5, 6) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_words int, _w int")
    got = q.verdicts(df).collect()
    assert len(got) == len(rows)
    want = collections.Counter((i, *brute(t)) for i, t in rows)
    assert collections.Counter(tuple(r)[:-1] for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def clean(rng, n=90):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n))


def test_limits_follow_language_and_source(spark):
    rng = random.Random(1)
    # in source "tables" a bar behind every second word is usual, elsewhere it is not
    bars = lambda t: " ".join(w + ("|" if k % 2 else "") for k, w in enumerate(t.split()))
    rows = [(i, clean(rng), "en", "prose") for i in range(200)]
    rows += [(200 + i, bars(clean(rng)), "en", "tables") for i in range(200)]
    rows += [(400, bars(clean(rng)), "en", "prose"), (401, clean(rng), "xx", "rare"), (402, clean(rng).replace(" ", "### "), "en", "prose")]
    kept = {r.doc_id for r in q.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect() if r.kept}
    assert kept == set(range(400)) | {401}


def test_keep_good_returns_the_same_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in q.verdicts(df).where("kept").collect()}
    rows = q.keep_good(df)
    assert rows.columns == df.columns
    assert sorted(r.doc_id for r in rows.collect()) == sorted(kept)


def test_sketch_quantile_is_close(spark):
    values = [(1.0 + i / 7,) for i in range(1000)]
    df = spark.createDataFrame(values, "x double").selectExpr("1 as g", "'word_length' as ratio", "x").select("g", "ratio", q._bin(q.F.col("x")).alias("bin"))
    row = q._quantiles(df.withColumn("n", q.F.lit(1)), ["g"]).first()
    exact = [sorted(v for (v,) in values)[int(p * 999)] for p in (0.25, 0.5, 0.75)]
    assert abs((row.hi_word_length + row.lo_word_length) / 2 / exact[1] - 1) <= q.ACCURACY
    assert abs((row.hi_word_length - row.lo_word_length) / 2 / (5 * (exact[2] - exact[0])) - 1) <= 4 * q.ACCURACY


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert q.verdicts(df).count() == 0 and q.keep_good(df).count() == 0
