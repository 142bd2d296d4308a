import collections
import hashlib
import random
import re

from tidemark.llm import private_data as p

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return True


def brute(text):
    spans = [(k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], text or "") if holds(k, m[0])]
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (*[sum(x == k for x, _, _ in spans) for k in BASE], hashlib.sha256(listed.encode()).hexdigest()), listed


def texts():
    rng = random.Random(2)
    bits = ["a", "b.c", "@", ".", "..", "1", "22", "256", "255", "+", "+4", " ", "-", "(", ")", "4111 1111 1111 1111", "x@y.z", "_d@e.f", "é",
            "🙂", "1.2.3.4", "00255.1.1.1", "+1 (555) 123-4567", "4222222222222", "6011000990139424", "\n"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    return [None, "", "a@b.c_d@e.f g@h@i.j", "1.2.3.4.5.6.7.8.9", "a" * 30_000, "1" * 30_000, "1 " * 20_000, "+1" + " " * 20_000, "a@b.c " * 3000, "@" * 5000, *made]


def test_base_spans_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(2, texts()[2]), (None, "mail x@y.z"), (4, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as kind", "3 as start")
    got = collections.Counter(tuple(r)[:6] for r in p.find(df).collect())
    assert got == collections.Counter((i, *brute(t)[0]) for i, t in rows)


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(7)
    phone = lambda: f"+1 (555) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
    rows = [(i, f"{rng.choice(['please', 'do', 'then'])} telephone: {phone()} today") for i in range(40)]
    rows += [(100, "my telephone: 555-301-{0} today".format(4455)), (101, "version 2024-01-02-77 was out"), (102, "the order 555-301-9999 shipped")]
    got = {r.doc_id: r for r in p.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:14:26" and got[100].n_phone == 0 and got[100].n_added == 1
    assert got[101].spans == "" and got[102].spans == ""
    assert all(got[i].n_phone == 1 and got[i].n_added == 0 for i in range(40))


def test_accepted_instances_become_seeds(spark):
    """Spaced phones and spelled-out addresses; those beside 'hotline' only are found by way of the first found ones."""
    rng = random.Random(9)
    filler = lambda: rng.choice(["please", "do", "then", "so", "if", "they"])
    phone = lambda: f"+49 {rng.randint(100, 999)} {rng.randint(100000, 999999)}"
    rows = [(i, f"{filler()} call telephone {phone()} today {filler()}") for i in range(60)]
    rows += [(100 + i, f"{filler()} write mail a{i}.b@c{i}.org for {filler()}") for i in range(60)]
    spaced = [f"0151 44{k:02} {rng.randint(10, 99)}" for k in range(30)]
    rows += [(200 + i, f"{filler()} call telephone {x} today, or ask hotline {x} at night") for i, x in enumerate(spaced)]
    rows += [(300, "or ask hotline (030) 55 12 34, at night"), (301, "write mail jane.doe(at)example.com for it"), (302, "write mail root@localhost for it")]
    rows += [(400, "about 12 34 56 things in 2024"), (401, "the year 1999 and 3.5 percent")]
    got = {r.doc_id: r for r in p.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200].n_added == 2 and got[200].n_phone == 0
    assert got[300].spans == "phone:15:29"
    assert got[301].spans == "email:11:34" and got[302].spans == "email:11:25"
    assert got[400].spans == got[401].spans == ""
    planted = [i for i in got if 200 <= i < 400]
    assert sum(got[i].n_added > 0 for i in planted) / len(planted) >= 0.9
    one = p.bootstrap(p.mentions(p.F.broadcast(spark.createDataFrame(rows, "id long, _text string")).withColumn("text_hash", p.F.lit(0))), rounds=1)
    assert not one.where("id = 300").count()


def test_generated_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in p.op3_private_data(spark, "/root/testdata/sf0.01").collect()}
    for r in rows:
        want, listed = brute(r.text)
        assert tuple(got[r.doc_id])[1:6] == want
        if not got[r.doc_id].n_added:
            assert got[r.doc_id].spans == listed


def test_empty_table(spark):
    assert p.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
