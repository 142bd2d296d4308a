"""Line dedup by a suffix array over line ids.

The lines of a document that hold a word are a sequence of line ids. Suffixes of these sequences are
sorted by distributed prefix doubling: from ranks by the first k lines come ranks by the first 2k, from
pairs of ranks k lines apart. A suffix whose rank is its own is settled and dropped, so that each round
works on what still repeats. Suffixes of one rank at depth k are an interval of the suffix array whose
common prefix is at least k lines. Between k and 2k lines an interval branches at depths of its own; a
binary descent over the stored ranks of the smaller powers of two finds them, with the parts that agree
on one more power going down as an interval of their own and their first place staying for all of them.
What is left are the intervals by longest common prefix: in one of d lines, the first place (smallest
id, then text hash, then line) stays and every other place begins a run of exactly d lines that begins
earlier too, and no longer one does. Such runs are deleted where they have `MIN_LINES` lines or are one
line of `MIN_CHARS` characters.

Lines without a word are no part of the sequence and stay. Null or empty text has no lines. Rows that
repeat id and text are one document, with the same result each. Texts keep what is left of them, which
may be nothing. Only the id and text columns are read; an empty table gives an empty result.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._common import scratch

MIN_LINES, MIN_CHARS = 2, 20
SPACES = " \t\n\x0b\f\r"

_DOC = ("id", "text_hash")
_PLACE = (*_DOC, "pos")


def _first(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first): the keys that several places have, with the smallest place."""
    groups = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_PLACE)).alias("first"))
    return groups.where("n > 1").drop("n")


def _intervals(keyed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, rank, first): the keys that several places have, ranked in their order."""
    ranked = _first(keyed, keys).sort(*keys).select(*keys, F.monotonically_increasing_id().alias("rank"), "first")
    return scratch(keyed.sparkSession, ranked, name)  # written once: ranks are the same for all that follows


def _is_later():
    return F.struct(*[F.col(c) for c in _PLACE]) > F.col("first")


def _doubled(df: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """For each depth 2 ** t the places whose run of that depth repeats.

    (place, rank, later, long, next_rank, next_later): the rank at this depth, whether another place of
    the rank is earlier, and the same at twice the depth (null where that run is the place's own).
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")).alias("pos", "line"))
    # two hashes of 64 bits are the line's id
    ids = lines.select(*_PLACE, F.xxhash64("line").alias("x"), F.xxhash64(F.lit(17), "line").alias("y"), (F.length("line") >= MIN_CHARS).alias("long"))
    intervals = _intervals(ids, ["x", "y"], "lines-1")
    active = scratch(spark, ids.join(intervals, ["x", "y"]).select(*_PLACE, "rank", _is_later().alias("later"), "long").distinct(), "lines-active")
    levels = []
    for t in count():
        ahead = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(2**t, 2**t)
        pairs = active.select(*_PLACE, F.col("rank").alias("x"), F.max("rank").over(ahead).alias("y"), "later", "long")
        intervals = _intervals(pairs.where("y is not null"), ["x", "y"], f"lines-{2 ** (t + 1)}")
        if intervals.isEmpty():
            levels.append(active.withColumns({"next_rank": F.lit(None).cast("long"), "next_later": F.lit(None).cast("boolean")}))
            return levels
        step = pairs.join(intervals.withColumnRenamed("rank", "next_rank"), ["x", "y"], "left")
        step = step.select(*_PLACE, F.col("x").alias("rank"), "later", "long", "next_rank", F.when(F.col("first").isNotNull(), _is_later()).alias("next_later"))
        levels.append(scratch(spark, step, f"lines-step-{2**t}"))
        active = levels[-1].where("next_rank is not null").select(*_PLACE, F.col("next_rank").alias("rank"), F.col("next_later").alias("later"), F.lit(True).alias("long"))
    return levels


def later_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, pos, depth, long): places at which a later copy of a run begins, and its exact length.

    `depth` is the longest run from there that also begins at an earlier place; `long` holds for runs of
    two lines and for lines of `MIN_CHARS` characters.
    """
    spark = df.sparkSession
    levels = _doubled(df, id_col, text_col)
    # a place is settled at the first depth at which its run is its own, or the first of its kind
    settled = [x.where("next_rank is null or not next_later") for x in levels]
    exact = [settled[0].where("later").select(*_PLACE, F.lit(1).alias("depth"), "long")]
    items = None
    for u in range(len(levels) - 2, -1, -1):
        joins = settled[u + 1].select(*_PLACE, F.xxhash64("rank", F.lit(u)).alias("g"), F.xxhash64(F.lit(u), "rank").alias("h"), F.lit(2 ** (u + 1)).alias("depth"))
        items = joins if items is None else items.unionByName(joins)
        ranks = levels[u].select("id", "text_hash", F.col("pos").alias("at"), F.col("rank").alias("r"))
        seen = items.join(ranks, items["id"].eqNullSafe(ranks["id"]) & (items["text_hash"] == ranks["text_hash"]) & (items["pos"] + items["depth"] == ranks["at"]), "left")
        seen = seen.select(*[items[c] for c in (*_PLACE, "g", "h", "depth")], "r")
        # written, so that the join reads both sides from shuffles and a group of very many places can be split
        groups = scratch(spark, _first(seen.where("r is not null"), ["g", "h", "r"]), f"lines-groups-{2**u}")
        dealt = seen.join(groups, ["g", "h", "r"], "left")
        stays = dealt.where("first is null or first = struct(id, text_hash, pos)").select(*_PLACE, "g", "h", "depth")
        goes = dealt.where("first is not null").select(
            *_PLACE, F.xxhash64("g", "h", "r", F.lit(u)).alias("g"), F.xxhash64(F.lit(u), "r", "h", "g").alias("h"), (F.col("depth") + 2**u).alias("depth"))
        items = scratch(spark, stays.unionByName(goes), f"lines-dealt-{2**u}")
    if items is not None:
        later = items.join(scratch(spark, _first(items, ["g", "h"]), "lines-firsts"), ["g", "h"]).where(_is_later())
        exact.append(later.select(*_PLACE, "depth", F.lit(True).alias("long")))
    return reduce(lambda a, b: a.unionByName(b), exact)


def deletions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, runs array<struct<pos, depth>>, longest): what each document that loses lines loses."""
    runs = later_copies(df, id_col, text_col).where((F.col("depth") >= MIN_LINES) | F.col("long"))
    return runs.groupBy(*_DOC).agg(F.collect_list(F.struct("pos", "depth")).alias("runs"), F.max("depth").alias("longest"))


def covered_lines(runs: list[dict] | None) -> set[int]:
    """The lines under the runs; a run inside the one before it adds none."""
    gone: set[int] = set()
    reached = 0
    for run in sorted(runs or (), key=lambda r: r["pos"]):
        end = run["pos"] + run["depth"]
        gone.update(range(max(run["pos"], reached), end))
        reached = max(reached, end)
    return gone


def _kept_lines(text: str, gone: set[int]) -> tuple[str, int]:
    """The text without its `gone` lines, counted over lines with a word; and that count."""
    out, n = [], 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if n not in gone:
                out.append(line)
            n += 1
        else:
            out.append(line)
    return "\n".join(out), n


def _with_deletions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    gone = scratch(df.sparkSession, deletions(df, id_col, text_col), "lines-gone")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    return rows.join(gone, rows["_id"].eqNullSafe(gone["id"]) & (rows["_hash"] == gone["text_hash"]), "left")


def line_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, longest_run, kept_sha256) of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, removed, sha = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                under = covered_lines(gone)
                kept, n = _kept_lines(text, under)
                lines.append(n)
                removed.append(len(under))
                sha.append(hashlib.sha256(kept.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), batch.column(3), pa.array(sha, pa.string())],
                                             ["doc_id", "n_lines", "n_removed", "longest_run", "kept_sha256"])

    rows = _with_deletions(df, id_col, text_col).select(F.col("_id").cast("long").alias("doc_id"), "_text", "runs", F.coalesce("longest", F.lit(0)).cast("long").alias("longest_run"))
    return rows.mapInArrow(digest, "doc_id long, n_lines long, n_removed long, longest_run long, kept_sha256 string")


def without_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True) -> DataFrame:
    """df with the later copies deleted from its text; a text that lost its last line goes, if asked."""

    @F.pandas_udf("string")
    def rest(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return texts.combine(runs, lambda t, r: _kept_lines(t, covered_lines(None if r is None else list(r)))[0])

    rows = _with_deletions(df, id_col, text_col)
    text = F.when(F.col("runs").isNull(), F.col(f"_row.`{text_col}`")).otherwise(rest("_text", "runs"))
    out = rows.select(F.col("runs").isNotNull().alias("_cut"), *[(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in df.columns])
    if drop_emptied:
        out = out.where(~(F.col("_cut") & (F.translate(text_col, SPACES, "") == "")))
    return out.drop("_cut")


def op2_line_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` without the later copies of repeated line runs, as digests."""
    return line_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = rf"""
WITH RECURSIVE raw AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
every AS (SELECT doc_id, u.line, u.i, regexp_matches(u.line, '[^\x20\x09-\x0D]') AS has FROM raw, unnest(ls) WITH ORDINALITY AS u(line, i)),
ln AS MATERIALIZED (SELECT *, sum(has::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM every),
l0 AS MATERIALIZED (SELECT doc_id, pos, length(line) AS n, dense_rank() OVER (ORDER BY line) AS r FROM ln WHERE has),
runs AS (SELECT 1 AS d, doc_id, pos, n, r, row_number() OVER w > 1 AS later FROM l0 WINDOW w AS (PARTITION BY r ORDER BY doc_id, pos) QUALIFY count(*) OVER (PARTITION BY r) > 1
    UNION ALL
    SELECT d + 1, doc_id, pos, n, dense_rank() OVER (ORDER BY r, r1), row_number() OVER w > 1
    FROM (SELECT a.*, b.r AS r1 FROM runs a JOIN l0 b ON a.doc_id = b.doc_id AND b.pos = a.pos + a.d)
    WINDOW w AS (PARTITION BY r, r1 ORDER BY doc_id, pos) QUALIFY count(*) OVER (PARTITION BY r, r1) > 1),
longest AS (SELECT doc_id, pos, max(d) AS d FROM runs WHERE later AND (d >= {MIN_LINES} OR n >= {MIN_CHARS}) GROUP BY doc_id, pos),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos::BIGINT, (pos + d)::BIGINT)) AS pos FROM longest),
deep AS (SELECT doc_id, max(d) AS longest FROM longest GROUP BY doc_id),
kept AS (SELECT ln.doc_id, count(*) FILTER (has) AS n_lines, count(g.pos) AS n_removed,
                coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.pos IS NULL), '') AS rest
         FROM ln LEFT JOIN gone g ON has AND g.doc_id = ln.doc_id AND g.pos = ln.pos GROUP BY ln.doc_id)
SELECT doc_id, n_lines, n_removed, coalesce(longest, 0)::BIGINT AS longest_run, sha256(rest) AS kept_sha256 FROM kept LEFT JOIN deep USING (doc_id)"""
