import pytest

from tidemark.llm import mixing as m

DDL = "doc_id long, text string, lang string, source string, weight int, topic int"


def rows():
    out = []
    for i in range(400):
        text = " ".join(["w"] * (1 + i % 37)) + (" a@b.c" if i % 5 == 0 else "") + (" x | y" if i % 7 == 0 else "")
        out.append((i, text, "en" if i % 3 else "fr", "hot" if i % 4 else f"s{i % 6}", 1, 2))
    return out


def test_margins_meet_targets(spark):
    df = spark.createDataFrame(rows(), DDL)
    targets = {"lang": spark.createDataFrame([("en", 0.25), ("fr", 0.75)], "_lang string, target double")}
    cells = m.cell_columns(df).groupBy("_source", "_lang", "_topic").agg(m.F.sum("_tokens").alias("tokens"))
    weights, residual = m.rake(cells, targets)
    assert 0 < residual < 0.05  # some sources have one language only, so that not all margins can be met
    got = weights.join(cells, ["_source", "_lang", "_topic"]).toPandas()
    got["mass"] = got.tokens * got.weight
    share = got.groupby("_lang").mass.sum() / got.mass.sum()
    assert share["fr"] == pytest.approx(0.75, abs=1e-2)
    tokens = got.groupby("_topic").tokens.sum() ** m.TEMPER
    assert (got.groupby("_topic").mass.sum() / got.mass.sum()).to_dict() == pytest.approx((tokens / tokens.sum()).to_dict(), abs=1e-2)


def test_sample_follows_the_probabilities(spark):
    df = spark.createDataFrame(rows(), DDL)
    got = m.probabilities(df).collect()
    assert len(got) == 400
    kept = m.sample(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got for _ in range(r.copies))
    assert sum(r.copies for r in got) == pytest.approx(sum(r.expected for r in got), rel=0.2)
    assert all(r.copies in (int(r.expected), int(r.expected) + 1) and r.sampled == (r.copies > 0) for r in got)


def test_expected_shares_meet_the_targets(spark):
    """The expected copies, not only the weights: no mass is lost where a weight asks for more than one copy."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = m.probabilities(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").toPandas()
    got["mass"] = got.n_tokens * got.expected
    for dim in ("topic", "lang", "source"):
        tokens = got.groupby(dim).n_tokens.sum() ** m.TEMPER
        assert (got.groupby(dim).mass.sum() / got.mass.sum()).to_dict() == pytest.approx((tokens / tokens.sum()).to_dict(), rel=1e-2)


def test_topic_column_and_odd_targets(spark):
    df = spark.createDataFrame(rows(), DDL)
    targets = {"source": spark.createDataFrame([("hot", 0.5), ("s1", 0.5)], "_source string, target double")}
    got = m.probabilities(df, targets=targets, topic_col="topic").toPandas()
    assert set(got.topic) == {"2"} and got.weight.notna().all()


def test_edge_rows(spark):
    odd = [(1, None, None, None, 0, 0), (1, None, None, None, 0, 0), (None, "", "", "", 0, 0), (3, "x " * 50_000, None, "s", 0, 0)]
    got = m.probabilities(spark.createDataFrame(odd, DDL)).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 0, 50_000]
    assert len({r.sampled for r in got if r.doc_id == 1}) == 1
    assert m.probabilities(spark.createDataFrame([], DDL)).count() == 0


def test_sample_meets_the_targets(spark):
    """A scarce language whose target is far over its share: its documents have to come several times."""
    data = [(i, "w " * 20, "es" if i % 50 == 0 else "en", "a" if i % 3 else "b", 0, 0) for i in range(3000)]
    df = spark.createDataFrame(data, DDL)
    targets = {"lang": spark.createDataFrame([("es", 0.2), ("en", 0.8)], "_lang string, target double")}
    kept = m.sample(df, targets=targets).toPandas()
    assert (kept.lang == "es").mean() == pytest.approx(0.2, abs=0.02)
    assert len(kept) == pytest.approx(1500, rel=0.05)
    decided = {r.doc_id for r in m.probabilities(df, targets=targets).where("sampled").collect()}
    assert set(kept.doc_id) == decided
