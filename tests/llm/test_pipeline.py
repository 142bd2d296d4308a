import base64
import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline as c
from tests.llm import test_near_dedup as near
from tests.llm import test_quality_rules as rules
from tidemark.llm import line_dedup, mixing, near_dedup, quality_rules

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, outputs = docs.columns, []
    for k, (_, stage) in enumerate(c.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(out)
        outputs.append((docs, docs := spark.read.parquet(out)))
        if k < len(c.STAGES) - 1:
            assert docs.columns == columns
    pairs = [(a.toPandas().set_index("doc_id"), b.toPandas().set_index("doc_id")) for a, b in outputs]

    before, after = pairs[0]  # the verdicts themselves are held against SQL and brute force elsewhere
    failed = {i for i, t in before.text.items() if rules.brute(t)[-1]}
    assert not failed & set(after.index)
    verdicts = {r.doc_id for r in quality_rules.verdicts(outputs[0][0]).where("kept").collect()}
    assert set(after.index) == verdicts

    before, after = pairs[1]
    seen1, seen2, left = set(), set(), {}
    for i, text in before.text.sort_index().items():
        rows = [x for x in text.split("\n") if x.strip(line_dedup.SPACES)]
        gone = set()
        for k, x in enumerate(rows):
            if x in seen1 and len(x) >= line_dedup.MIN_CHARS:
                gone.add(k)
            seen1.add(x)
            if k + 1 < len(rows):
                if (x, rows[k + 1]) in seen2:
                    gone |= {k, k + 1}
                seen2.add((x, rows[k + 1]))
        left[i] = line_dedup._kept_lines(text, gone)[0]
    assert after.text.to_dict() == {i: t for i, t in left.items() if t.strip(line_dedup.SPACES)}
    assert (after.n_chars == after.text.map(len)).all()

    before, after = pairs[2]
    rows = list(before.text.items())
    groups = near.brute(rows, near_dedup._idf(outputs[2][0].select("text")))
    assert sorted(after.index) == sorted(min(i for i, _ in g) for g in groups)

    before, after = pairs[3]
    decided = {r.doc_id for r in mixing.probabilities(outputs[3][0]).where("sampled").collect()}
    assert set(after.index) == decided and after.text.to_dict() == before.text[sorted(decided)].to_dict()

    before, after = pairs[4]
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in before.text.items():
        ids = enc.encode_ordinary(text)
        assert (after.n_tokens[i], after.ids_sha256[i]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert after.decoded_sha256[i] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in c.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
