"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base spans are what the four base patterns find, each kind from left to right without overlaps: mail
addresses, IP addresses (parts up to 255), card numbers (16 to 19 digits that pass the Luhn test) and
phone numbers (8 to 15 digits). They are the first seeds. A round of the bootstrap then goes:

1. The seeds induce lexical patterns: the word and the two words left of them, and the word right of them.
   A pattern has the confidence of a kind by the share of that kind among the instances it has, smoothed;
   it counts from `MIN_SEEDS` different seeds and a confidence of `MIN_CONFIDENCE` on.
2. On the graph of patterns and instances, the score of an instance that is no seed is the noisy-or of the
   confidences of its patterns. Instances of `ACCEPT` or more become seeds of their kind.

With the new seeds the patterns are induced again, so that identifiers are found which stand beside no
pattern of the first seeds. This goes on until no round changes the accepted ones, or `ROUNDS` times.
Accepted instances are added as spans where one of their own patterns is trusted, as long as they overlap
no base span.

Instances are whatever may be an identifier: tokens of any length with a digit or an at sign, groups of
digits with single spaces between them, and addresses whose at sign is spelled out in brackets. What has
none of these is never an instance. Context words count with their `REACH` nearest characters.

Offsets are code points, ends exclusive. Null or empty text has no spans. Rows that repeat id and text
have the same result each. Only the id and text columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import scratch

ROUNDS, MIN_SEEDS, SMOOTHING, MIN_CONFIDENCE, ACCEPT = 6, 5, 2.0, 0.3, 0.8
REACH = 80
KINDS = ("email", "ip", "card", "phone")
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_GROUP = r"[(]?[0-9]++[)]?+(?:[./-][0-9]++)*+"
#: The base patterns, written so that no text makes them recurse or start again inside a run: repeated
#: parts are possessive (nothing after them could use what they give back), and a start inside a run of
#: the leading class is only tried where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # shorter runs of digits cannot become cards; a longer one is matched whole and then dropped
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){15}(?:[\x20-]?[0-9])*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # an address with its at sign in brackets, or spaced groups of digits, or any token with a digit or an at sign
    "token": r"(?<!\S)(?:[^\s@\[\](){}<>,;:]++\x20?[\[({](?i:at)[\])}]\x20?[^\s@\[\](){}<>,;:]*[A-Za-z0-9]"
             rf"|{_GROUP}(?:\x20{_GROUP})++(?!\w)"
             r"|(?=[^\s0-9@]*+[0-9@])\S*[^\s.,;:!?)\]}\x22\x27])",
}
#: Other texts are not searched.
_GATES = {"email": "instr({t}, '@') > 0", "ip": "instr({t}, '.') > 0", "card": "{t} rlike '[0-9]'", "phone": "instr({t}, '+') > 0",
          "token": r"{t} rlike r'[0-9@]|[\[({{](?i:at)[\])}}]'"}
_CHUNK = 512


def _valid(kind: str, x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    if kind == "ip":
        return f"{x} rlike r'^{_OCTET}(?:[.]{_OCTET}){{3}}$'"
    if kind == "phone":
        return f"length({digits}) between 8 and 15"
    if kind == "card":
        digit = f"int(substring({digits}, -i, 1))"
        luhn = f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + if(i % 2 = 1, {digit}, {digit} * 2 - if({digit} > 4, 9, 0)))"
        return f"length({digits}) between 16 and 19 and if(length({digits}) between 16 and 19, {luhn} % 10 = 0, false)"
    return "true"


def with_spans(df: DataFrame, text_col: str, kinds: tuple[str, ...]) -> DataFrame:
    """df with a column for each kind: array<struct<start,end>> of its matches that hold."""
    names = [f"`{c}`" for c in df.columns]
    found = []
    for k in kinds:
        gate = _GATES[k].format(t=text_col)
        found += [f"if({gate}, regexp_extract_all({text_col}, r'{PATTERNS[k]}', 0), array()) as _m_{k}"]
    step = df.selectExpr(*names, *found)
    # what lies between the matches gives their offsets; texts without a match are not split
    step = step.selectExpr("*", *[f"if(size(_m_{k}) > 0, split({text_col}, r'{PATTERNS[k]}', -1), array()) as _p_{k}" for k in kinds])
    step = step.selectExpr("*", *[f"zip_with(_p_{k}, _m_{k}, (p, m) -> bigint(length(p) + coalesce(length(m), 0))) as _s_{k}" for k in kinds])
    # sums of every _CHUNK matches, then of what comes before each chunk, so that very many matches take no quadratic time
    step = step.selectExpr("*", *[f"transform(sequence(0, size(_s_{k}) div {_CHUNK}), c -> aggregate(slice(_s_{k}, int(c * {_CHUNK}) + 1, {_CHUNK}), 0L, (a, x) -> a + x)) as _q_{k}" for k in kinds])
    step = step.selectExpr("*", *[f"transform(_q_{k}, (q, c) -> aggregate(slice(_q_{k}, 1, c), 0L, (a, x) -> a + x)) as _b_{k}" for k in kinds])
    spans = []
    for k in kinds:
        start = (f"get(_b_{k}, int(i div {_CHUNK})) + aggregate(slice(_s_{k}, int(i div {_CHUNK}) * {_CHUNK} + 1, i % {_CHUNK}), 0L, (a, x) -> a + x) "
                 f"+ length(get(_p_{k}, i))")
        spans.append(f"filter(transform(_m_{k}, (m, i) -> struct({start} as start, m as m)), s -> {_valid(k, 's.m')}) as _f_{k}")
    step = step.selectExpr(*names, *spans)
    packed = ", ".join(f"transform(_f_{k}, s -> struct(s.start as start, s.start + length(s.m) as end)) as {k}" for k in kinds)
    # generated, not projected: filters on the spans must not pull the search below them
    return step.selectExpr(*names, f"explode(array(struct({packed}))) as _x").select(*names, "_x.*")


def _context(kind: str, start: str, end: str) -> str:
    """The neighbouring words of a span, lower case, digits as 0, without punctuation at their ends."""
    clean = lambda word: f"regexp_replace(regexp_replace(lower({word}), '[0-9]+', '0'), r'^\\W+|\\W+$', '')"
    before = f"substring(_text, int(greatest({start} - {REACH}, 0)) + 1, int(least({start}, {REACH})))"
    left, two = rf"regexp_extract({before}, r'(\S+)\s*$', 1)", rf"regexp_extract({before}, r'(\S+\s+\S+)\s*$', 1)"
    right = rf"regexp_extract(substring(_text, int({end}) + 1, {REACH}), r'^\s*(\S+)', 1)"
    surface = f"substring(_text, int({start}) + 1, int({end} - {start}))"
    return f"struct({kind} as kind, {start} as start, {end} as end, {surface} as surface, {clean(left)} as l, {clean(two)} as ll, {clean(right)} as r)"


def mentions(docs: DataFrame) -> DataFrame:
    """(id, text_hash, kind, start, end, surface, l, ll, r): base spans with their kind, other instances with kind ''."""
    free = " and ".join(f"not exists({k}, b -> b.start < s.end and s.start < b.end)" for k in KINDS)
    seeds = ", ".join(f"transform({k}, s -> {_context(repr(k), 's.start', 's.end')})" for k in KINDS)
    others = f"transform(filter(token, s -> {free}), s -> {_context(repr(''), 's.start', 's.end')})"
    rows = with_spans(docs, "_text", (*KINDS, "token"))
    return rows.selectExpr("id", "text_hash", f"explode(concat({seeds}, {others})) as _m").select("id", "text_hash", "_m.*")


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, text_hash, kind, start, end) of the instances that the seeds' patterns vouch for."""
    spark = found.sparkSession
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("word")) for side in ("l", "ll", "r")]))
    edges = found.select("surface", "kind", sides.alias("_p")).select("surface", "kind", "_p.side", "_p.word").where("word != ''").distinct()
    edges = scratch(spark, edges, "pii-edges")
    size = scratch(spark, edges.groupBy("side", "word").agg(F.count(F.lit(1)).alias("size")), "pii-sizes")
    given, open_ = edges.where("kind != ''").withColumnRenamed("kind", "to"), edges.where("kind = ''").drop("kind")
    accepted, patterns, known = None, None, []
    for _ in range(rounds):
        seeds = given if accepted is None else given.unionByName(open_.join(accepted, "surface"))
        support = seeds.groupBy("side", "word", "to").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= MIN_SEEDS)
        support = support.join(size, ["side", "word"]).select("side", "word", "to", (F.col("seeds") / (F.col("size") + SMOOTHING)).alias("confidence"))
        patterns = scratch(spark, support.where(F.col("confidence") >= MIN_CONFIDENCE), "pii-patterns")
        score = 1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))
        scores = open_.join(patterns, ["side", "word"]).groupBy("surface", "to").agg(score.alias("score")).where(F.col("score") >= ACCEPT)
        accepted = scratch(spark, scores.groupBy("surface").agg(F.max_by("to", F.struct("score", "to")).alias("to")), "pii-accepted")
        state = accepted.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("surface", "to")).alias("mark")).first()
        if state in known:
            break
        known.append(state)
    # an instance is taken where one of its own patterns is trusted, not wherever its characters occur
    trusted = patterns.where(F.col("confidence") >= ACCEPT / 2).drop("confidence")
    places = found.where("kind = ''").join(accepted, "surface").select("id", "text_hash", "start", "end", "to", sides.alias("_p"))
    places = places.select("id", "text_hash", "start", "end", "to", "_p.side", "_p.word").join(trusted, ["side", "word", "to"])
    return places.select("id", "text_hash", F.col("to").alias("kind"), "start", "end").distinct()


def _listed(spans: Column) -> Column:
    """kind:start:end of array<struct<k, start, end>>, by kind as listed, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), text), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("_text"))
    found = scratch(spark, mentions(docs), "pii-mentions")
    number = (F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1).cast("int").alias("k")
    span = F.struct(number, F.col("start"), F.col("end"))
    base = found.where("kind != ''").groupBy("id", "text_hash").agg(F.collect_set(span).alias("base"))
    added = scratch(spark, bootstrap(found), "pii-added").groupBy("id", "text_hash").agg(F.collect_set(span).alias("added"))
    keys = docs.select("id", "text_hash")
    match = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["text_hash"] == b["text_hash"])
    rows = keys.join(base, match(keys, base), "left").select(keys["id"], keys["text_hash"], "base")
    rows = rows.join(added, match(rows, added), "left").select(rows["id"], "base", "added")
    none = F.array().cast("array<struct<k:int,start:bigint,end:bigint>>")
    rows = rows.select("id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))
    count = lambda i: F.size(F.filter("base", lambda s: s["k"] == i)).cast("long")
    return rows.select(
        F.col("id").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every whole text of `documents`."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
