import collections
import hashlib
import random

from tidemark.llm import line_dedup as d


def brute(rows):
    """Rows repeating id and text are one document."""
    order = lambda r: (r[0] is not None, r[0] or 0, d_hash[r[1] or ""])
    d_hash = brute.hashes
    docs = sorted({(i, t or "") for i, t in rows}, key=order)
    seen1, seen2, gone = set(), set(), {}
    for i, t in docs:
        lines = [x for x in t.split("\n") if x.strip(d.SPACES)]
        g = set()
        for k, x in enumerate(lines):
            if x in seen1 and len(x) >= d.MIN_CHARS:
                g.add(k)
            seen1.add(x)
            if k + 1 < len(lines):
                if (x, lines[k + 1]) in seen2:
                    g |= {k, k + 1}
                seen2.add((x, lines[k + 1]))
        gone[i, t] = g, len(lines)
    out = collections.Counter()
    for i, t in rows:
        g, n = gone[i, t or ""]
        out[i, n, len(g), hashlib.sha256(d._kept_lines(t or "", g)[0].encode()).hexdigest()] += 1
    return out


def corpus():
    rng = random.Random(8)
    lines = ["}", "a", "b c", "", "  ", "a line of more than twenty characters", "another line, also more than twenty", "é" * 25, "\t"]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.6 else f"own {rng.randint(0, 10**9)}" for _ in range(rng.randint(0, 25)))) for i in range(80)]
    block = "\n".join(f"shared {k}" for k in range(40))
    rows += [(100 + i, f"head {i}\n{block}\ntail {i}") for i in range(6)]
    return rows + [(200, None), (201, ""), (202, "\n\n"), (203, "x\n" * 3000), (204, rows[5][1]), (204, rows[5][1]), (204, "a\nb c"), (None, block)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as gone", "3 as pos")
    brute.hashes = {r.t: r.h for r in df.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()}
    got = d.line_digest(df).collect()
    assert collections.Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in got) == brute(rows)
    runs = {r.doc_id: r.longest_run for r in got}
    assert runs[101] == 40 and runs[203] == 2999 and runs[200] == 0


def test_texts_and_columns(spark):
    rows = [(1, "the first long line of this text\nb", 5), (2, "the first long line of this text", 6), (3, None, 7), (4, "keep\nthe first long line of this text", 8)]
    got = d.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, gone int"))
    assert got.columns == ["doc_id", "text", "gone"]
    assert sorted(map(tuple, got.collect())) == [(1, rows[0][1], 5), (3, None, 7), (4, "keep", 8)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert d.line_digest(empty).count() == 0 and d.without_repeated_lines(empty).count() == 0


def exact_runs(docs):
    """Place -> the longest run from there that also begins earlier, by comparing all places."""
    places = sorted((i, k) for i, lines in docs.items() for k in range(len(lines)))
    out = {}
    for n, (i, k) in enumerate(places):
        best = 0
        for j, m in places[:n]:
            d = 0
            while k + d < len(docs[i]) and m + d < len(docs[j]) and docs[i][k + d] == docs[j][m + d]:
                d += 1
            best = max(best, d)
        if best:
            out[i, k] = best
    return out


def test_runs_are_exact(spark):
    """Runs of any length, not only of powers of two, that overlap, nest and branch."""
    rng = random.Random(5)
    docs = {i: [rng.choice("ab" if i % 3 else "abcde") for _ in range(rng.randint(0, 14))] for i in range(40)}
    long = [f"line {k}" for k in range(23)]
    docs |= {50: long, 51: long[:19] + ["z"], 52: ["y", *long[2:13], "z"], 53: long, 54: long[5:] + long[:7]}
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string")
    got = d.later_copies(df).collect()
    assert len({(r.id, r.pos) for r in got}) == len(got)
    assert {(r.id, r.pos): r.depth for r in got} == exact_runs(docs)
