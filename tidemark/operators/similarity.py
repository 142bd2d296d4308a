"""The most similar text by the ratio of matching blocks, exact on the few that its bounds leave.

The ratio is 2 M / (la + lb), M the characters in the matching blocks that difflib finds (with its rule for
popular characters in texts of 200 and more). Its blocks are a common subsequence, so M is at most the shorter
length, the shared count of each character, and the longest common subsequence. Longer q-grams give no sound
bound here, as matching blocks may be single characters. The bounds are tried in this order, cheapest first; the
ratio itself is computed only while a bound exceeds the best one found.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.gram_index import GramIndex
from tidemark.operators.retrieval import token_search
from tidemark.session import written

#: Cells of a character count: characters share a cell by their code point, which only weakens the bound.
CELLS = 64


def matching_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit for each character of a."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def counts(texts: list[str]) -> np.ndarray:
    """How often the characters of each cell are in each text."""
    out = np.zeros((len(texts), CELLS), np.int32)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le"), "<u4") % CELLS, minlength=CELLS)
    return out


def best_match(a: str, texts: list[str], cells: np.ndarray, least: float = 0.0) -> tuple[int, float, int]:
    """(place, ratio, ratios computed) of the most similar text, the first of equals; place -1 if none exceeds `least`."""
    length = cells.sum(axis=1)
    shared = np.minimum(cells, counts([a])[0]).sum(axis=1)
    bound = 2 * shared / np.maximum(len(a) + length, 1)
    best, place, tried = least, -1, 0
    for i in np.argsort(-bound, kind="stable").tolist():
        if bound[i] < best or bound[i] == 0:
            break
        total = len(a) + len(texts[i])
        if 2 * common_subsequence(a, texts[i]) / total < best:
            continue
        tried += 1
        found = matching_ratio(a, texts[i])
        if found > best or (found == best and place > i):
            best, place = found, i
    return place, best, tried


def similar(stated: DataFrame, texts: DataFrame, q: str, probe: str, key: str, text: str, least: float = 0.6) -> DataFrame:
    """(q, key, ratio): all texts whose ratio to a stated text is `least` or more.

    The stated texts go to all tasks in blocks of bounded size; a pair that its bounds rule out makes no row.
    Null and empty texts match nothing.
    """
    wanted = stated.where(F.length(probe) > 0).select(q, probe)
    rows = texts.where(F.length(text) > 0).select(key, text)
    ddl = f"{q} {wanted.schema[q].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, ratio double"
    size = wanted.agg(F.sum(F.length(probe) + 64)).first()[0] or 0
    n = max(1, -(-int(size) // (4 << 20)))
    out = None
    for block in range(n):
        part = wanted if n == 1 else wanted.where(F.pmod(F.xxhash64(q, probe), F.lit(n)) == block)
        found = rows.mapInPandas(_similar(part.toPandas(), ddl, least), ddl)  # at most a block
        out = found if out is None else out.unionByName(found)
    return out


def _similar(stated: pd.DataFrame, ddl: str, least: float):
    names, probes = stated.iloc[:, 0].tolist(), stated.iloc[:, 1].tolist()
    mine = counts(probes)
    columns = [c.split()[0] for c in ddl.split(", ")]
    bare = np.array([len(p) for p in probes])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = []
            for key, text in frame.itertuples(index=False):
                length = len(text)
                near = np.flatnonzero(2 * np.minimum(bare, length) >= least * (bare + length))
                if len(near):
                    shared = np.minimum(mine[near], counts([text])[0]).sum(axis=1)
                    near = near[2 * shared >= least * (bare[near] + length)]
                for i in near.tolist():
                    if 2 * common_subsequence(probes[i], text) >= least * (len(probes[i]) + length):
                        ratio = matching_ratio(probes[i], text)
                        if ratio >= least:
                            found.append((names[i], key, ratio))
            if found:
                yield pd.DataFrame(found, columns=columns)

    return scan


def verified_evidence(evidence: DataFrame, chunks: DataFrame, index: GramIndex, q: str = "finding_id", k: int = 5, least: float = 0.6) -> DataFrame:
    """(q, found, chunk_id, similarity): whether a document holds what is cited as its evidence.

    evidence: q, doc_id, evidence; chunks: doc_id, chunk_id, content; index: of chunks by chunk_id, scope doc_id.
    The first 100 characters are searched in the document; of the first k chunks the first that holds the first
    200 counts as 1.0, else the best ratio to the first 500 of a chunk, found from `least` on. Blank evidence is
    not found.
    """
    spark = evidence.sparkSession
    stated = evidence.select(q, F.col("doc_id").cast("string").alias("scope"), "evidence")
    some = stated.where(F.trim(F.regexp_replace("evidence", r"\s", " ")) != "")
    searched = some.select(q, F.substring("evidence", 1, 100).alias("_s"))
    hits = token_search(searched, index, q, "_s", "chunk_id", k, allowed=some.select(q, "scope"))
    pairs = hits.join(chunks.select("chunk_id", "content"), "chunk_id").join(some.select(q, F.lower(F.substring("evidence", 1, 200)).alias("_p")), q)
    content = F.lower(F.coalesce("content", F.lit("")))
    pairs = written(spark, pairs.select(q, "rank", "chunk_id", "_p", content.contains(F.col("_p")).alias("_in"), F.substring(content, 1, 500).alias("_c")), "evidence-pairs")
    whole = pairs.where("_in").groupBy(q).agg(F.min_by("chunk_id", "rank").alias("chunk_id")).withColumn("similarity", F.lit(1.0))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        texts = group["_c"].tolist()
        place, ratio, _ = best_match(group["_p"].iloc[0], texts, counts(texts))
        return pd.DataFrame({q: group[q].iloc[:1], "chunk_id": [group["chunk_id"].iloc[place] if place >= 0 else None], "similarity": [ratio]})

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (q, "chunk_id")}
    loose = pairs.join(whole.select(q), q, "left_anti").groupBy(q).applyInPandas(best, f"{q} {kinds[q]}, chunk_id {kinds['chunk_id']}, similarity double")
    told = whole.unionByName(loose)
    rows = stated.select(q).join(told, q, "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    held = F.col("similarity") >= least
    return rows.select(q, held.alias("found"), F.when(held, F.col("chunk_id")).alias("chunk_id"), F.round("similarity", 3).alias("similarity"))
