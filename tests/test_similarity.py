"""The similarity leg against difflib over all pairs."""

import difflib
import random

from tidemark.operators import gram_index, similarity
from tidemark.sources import sinks

WORDS = "valve pump pipeline pressure inspection section operator leak repair emergency the of and 管道 巡线 应急".split()


def some_texts(draw, n):
    texts = [" ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 30))) for _ in range(n)]
    for i in range(0, n, 3):
        near = list(texts[i - 1])
        for _ in range(len(near) // 12):
            near[draw.randrange(len(near))] = draw.choice("abcxyz ")
        texts[i] = "".join(near)
    return texts


def test_the_bounds_are_bounds():
    draw = random.Random(2)
    texts = some_texts(draw, 60)
    cells = similarity.counts(texts)
    for a in texts[:25]:
        for b, c in zip(texts, cells, strict=True):
            blocks = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
            assert blocks <= similarity.common_subsequence(a, b) <= min(similarity.counts([a])[0], c, key=lambda x: x.sum()).sum()
            assert similarity.common_subsequence(a, b) <= int((similarity.counts([a])[0].clip(max=c)).sum())


def test_best_match_is_the_best_of_all_with_few_ratios():
    draw = random.Random(3)
    texts = some_texts(draw, 150)
    cells, tried = similarity.counts(texts), 0
    for a in some_texts(draw, 30):
        ratios = [difflib.SequenceMatcher(None, a, t).ratio() for t in texts]
        place, ratio, n = similarity.best_match(a, texts, cells)
        tried += n
        assert (place, ratio) == ((ratios.index(max(ratios)), max(ratios)) if max(ratios) > 0 else (-1, 0.0))
    assert tried < 0.25 * 30 * 150


def test_similar_as_all_pairs(spark):
    draw = random.Random(4)
    texts = some_texts(draw, 90)
    probes = [(f"q{i}", t[:200]) for i, t in enumerate(texts[:40])] + [("q90", None), ("q91", "")]
    rows = [(f"k{i}", t) for i, t in enumerate(texts)] + [("k90", None), ("k91", "")]
    got = {(r.q, r.k): r.ratio for r in similarity.similar(spark.createDataFrame(probes, "q string, p string"), spark.createDataFrame(rows, "k string, t string"), "q", "p", "k", "t").collect()}
    ratio = lambda p, t: difflib.SequenceMatcher(None, p, t).ratio()
    assert got == {(q, k): ratio(p, t) for q, p in probes if p for k, t in rows if t and ratio(p, t) >= 0.6}


def test_verified_evidence_as_a_plain_version(spark):
    draw = random.Random(5)
    chunks = [(f"d{i % 4}", f"c{i:03d}", t) for i, t in enumerate(some_texts(draw, 40))]
    evidence = [(f"f{i}", f"d{i % 5}", t[draw.randint(0, 5) :][: draw.randint(5, 250)].upper()) for i, (_, _, t) in enumerate(chunks)] + [("f90", "d1", None), ("f91", "d1", " \n"), ("f92", None, "valve pump"), ("f93", "d2", "nothing like this whatsoever")]
    df = spark.createDataFrame(chunks, "doc_id string, chunk_id string, content string")
    index = gram_index.build(df, "chunk_id", "content", "doc_id")
    got = {r.finding_id: (r.found, r.chunk_id, r.similarity) for r in similarity.verified_evidence(spark.createDataFrame(evidence, "finding_id string, doc_id string, evidence string"), df, index).collect()}
    assert len(got) == len(evidence)
    for name, doc, text in evidence:
        words = [w.lower() for w in (text or "")[:100].split() if len(w) >= 3 and w.upper() not in ("OR", "AND", "NOT")]
        mine = sorted((c, t.lower()) for d, c, t in chunks if d == doc)
        start = (text or "")[:100].lower()
        if not words and len("".join(start.split())) >= 3:
            words = [start.strip(" ")]
        found = [(c, t) for c, t in mine if any(w in t for w in words)][:5] if text and text.strip() else []
        if not found and text and text.strip():
            found = [(c, t) for c, t in mine if start in t][:5]
        whole = [c for c, t in found if text[:200].lower() in t]
        if whole:
            expected = (True, whole[0], 1.0)
        else:
            ratios = [(difflib.SequenceMatcher(None, text[:200].lower(), t[:500]).ratio(), c) for c, t in found]
            best = max((r for r, _ in ratios), default=0.0)
            expected = (best >= 0.6, next((c for r, c in ratios if r == best), None) if best >= 0.6 else None, round(best, 3))
        assert got[name] == expected, name


def test_placed_comments_as_difflib_over_all_paragraphs(spark):
    draw = random.Random(6)
    blocks = [(f"d{i % 3}", i, t) for i, t in enumerate(some_texts(draw, 60))] + [("d0", 99, None)]
    findings = [(f"d{i % 4}", (t[3:90] if i % 3 else t.upper()[::2]), f"{i}.{i}" if i % 7 == 0 else None, i) for i, (_, _, t) in enumerate(blocks[:40])] + [("d1", None, None, None)]
    rows = sinks.placed_comments(spark.createDataFrame(findings, "doc_id string, anchor_text string, section_path string, paragraph_index int"), spark.createDataFrame(blocks, "doc_id string, pos int, text string"))
    got = {(r.doc_id, r.paragraph_index): r.paragraph for r in rows.collect()}
    for doc, anchor, section, at in findings:
        texts = [t or "" for d, _, t in sorted(blocks, key=lambda b: b[1]) if d == doc]
        low, wanted = [t.lower()[:200] for t in texts], (anchor or "").lower()[:80]
        named = [i for i, t in enumerate(texts) if section and (section in t or section.rsplit(".", 1)[-1] in t)]
        held = [i for i, t in enumerate(low) if wanted and wanted in t]
        ratios = [difflib.SequenceMatcher(None, wanted, t[: len(wanted) + 40]).ratio() for t in low] if wanted else []
        if not texts:
            expected = 0
        elif named or held:
            expected = (named or held)[0]
        else:
            expected = ratios.index(max(ratios)) if ratios and max(ratios) > 0 else min(at or 0, len(texts) - 1)
        assert got[doc, at] == expected


def test_empty_tables(spark):
    none = spark.createDataFrame([], "q string, p string, q2 string, p2 string")
    assert similarity.similar(none, none, "q", "p", "q2", "p2").count() == 0
