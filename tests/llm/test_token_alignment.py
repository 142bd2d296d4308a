"""Alignment against whole texts encoded at once and all token pairs compared."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import token_alignment as t

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "\n", "a", " a", "a ", "a b", "a  b", "a\nb", "a \n b", "a\n\nb", "\na b", "\n a", "don't stop 's", "x y z", "tab\there 1 2", "é ü 日本語 テキスト", "emoji 👩‍👩‍👧 end",
    "<|endoftext|> a <|endoftext|>", "<s> </s> <unk> <0x0A>", "▁ a▁b ▁", "nul\x00 byte", "\x1c \x1d a", "a　 b", "line sep x", "1 2 3\n4 5.\n6", "!!! ??? ...", "a" * 300, "ﬁ ﬂ ligature", "é combining",
]


@pytest.fixture(scope="module")
def both():
    return t._tokenizers(*t._paths(None, None))


def plain(text, both):
    """(A ids, B ids, groups, links) of a whole text; None without tokens."""
    if not text:
        return None
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    x, y = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
    if not b"".join(x) == (" " + text).encode() == b"".join(y):
        return None
    spans = []
    for side in (x, y):
        at, out = 0, []
        for token in side:
            out.append((at, at + len(token)))
            at += len(token)
        spans.append(out)
    cuts = {e for _, e in spans[0]} & {e for _, e in spans[1]}
    groups, i, j = [], 0, 0
    for cut in sorted(cuts):
        i0, j0 = i, j
        while i < len(a) and spans[0][i][1] <= cut:
            i += 1
        while j < len(b) and spans[1][j][1] <= cut:
            j += 1
        groups.append((a[i0:i], b[j0:j]))
    links, j0 = [], 0
    for i, (s, e) in enumerate(spans[0]):
        while spans[1][j0][1] <= s:
            j0 += 1
        j = j0
        while j < len(b) and spans[1][j][0] < e:
            links.append((a[i], b[j]))
            j += 1
    return a, b, groups, links


def line(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def plain_rows(rows, both):
    found = [(ident, plain(text, both)) for ident, text in rows]
    count = Counter(pair for _, f in found if f for pair in set(f[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for ident, f in found:
        if not f:
            out.append((ident, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        out.append((ident, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(line(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r[0], r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


def test_query_as_a_plain_version(spark, both):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(t.op13_diagonal_runs(spark, SF)) == plain_rows(rows, both)


@pytest.mark.parametrize("text", ODD)
def test_units_give_what_the_whole_text_gives(text, both):
    found, expected = t.align(text, both, keep_groups=True), plain(text, both)
    if expected is None:
        assert found.n_a == found.n_b == found.n_groups == found.n_links == 0
        return
    a, b, groups, links = expected
    assert (found.n_a, found.n_b, found.n_links) == (len(a), len(b), len(links))
    assert ";".join(found.groups) == line(groups)
    assert dict(zip(found.codes.tolist(), found.times.tolist(), strict=True)) == {x * t.B_IDS + y: n for (x, y), n in Counter(links).items()}


def test_random_texts_and_small_blocks(both, monkeypatch):
    monkeypatch.setattr(t, "BLOCK_UNITS", 3)
    monkeypatch.setattr(t, "REMEMBERED", 40)
    draw = random.Random(3)
    for _ in range(150):
        text = "".join(draw.choice(["a", "word", "The", " ", " ", "\n", "é", ".", "'s", "9", "日", "\t", "zq", " ", "▁"]) for _ in range(draw.randint(1, 60)))
        found, expected = t.align(text, both, keep_groups=True), plain(text, both)
        assert ";".join(found.groups) == (line(expected[2]) if expected else "")
        assert found.n_links == (len(expected[3]) if expected else 0)


def test_diagonal_steps_over_stretches_of_any_length():
    draw = random.Random(9)
    for _ in range(400):
        n = draw.randint(1, 70)
        cut = sorted(draw.sample(range(1, 200), n)) + [200]
        ea = sorted(set(cut) - set(draw.sample(cut[:-1], draw.randint(0, min(3, n)))))
        eb = sorted(set(cut) | set(draw.sample(range(1, 200), draw.randint(0, 3))))
        parts, la, lb = t.diagonal(ea, eb)
        groups = []
        for i0, i1, j0, j1, single in parts:
            groups += [(ea[i], eb[j]) for i, j in zip(range(i0, i1), range(j0, j1), strict=True)] if single else [(ea[i1 - 1], eb[j1 - 1])]
        assert groups == [(e, e) for e in sorted(set(ea) & set(eb))]
        sa, sb = [0, *ea], [0, *eb]
        assert list(zip(la, lb, strict=True)) == [(i, j) for i in range(len(ea)) for j in range(len(eb)) if max(sa[i], sb[j]) < min(ea[i], eb[j])]


@pytest.mark.parametrize("frequent", [0, 1, 50, t.FREQUENT])
def test_rare_pairs_are_joined_and_frequent_ones_are_sent(spark, both, frequent):
    rows = [(i, text) for i, text in enumerate(ODD)] + [(i, "the same words again and again") for i in range(100, 120)] + [(None, "the same thing"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "code": F.lit(2), "row": F.lit(3)})
    assert got(t.pair_alignment(df, frequent=frequent)) == plain_rows(rows, both)


def test_least_count():
    assert t.least_count([], 5) == 1
    assert t.least_count([(1, 10), (2, 4), (3, 1)], 15) == 1
    assert t.least_count([(1, 10), (2, 4), (3, 1)], 14) == 2
    assert t.least_count([(1, 10), (2, 4), (3, 1)], 4) == 4
    assert t.least_count([(1, 10), (2, 4), (3, 1)], 0) == 8


def test_groups_as_rows_and_an_empty_table(spark, both):
    df = spark.createDataFrame([("x", "unalignable words, perhaps"), ("y", None)], "doc_id string, text string")
    rows = t.groups(df).orderBy("pos").collect()
    assert [(r.a, r.b) for r in rows] == [(a, b) for a, b in plain("unalignable words, perhaps", both)[2]] and {r.doc_id for r in rows} == {"x"}
    assert t.pair_alignment(df.limit(0)).count() == 0
