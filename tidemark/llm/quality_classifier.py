"""Quality classifier from weak labels.

Eight heuristic labellers vote on each document: good, bad or no vote. Expectation-maximisation over the
counts of the vote patterns (at most 3**8 of them, whatever the corpus) estimates how each labeller votes
on good and on bad documents, its accuracy, and from these the probability that a pattern is good. These
posteriors are the labels of a linear scorer over hashed words and hashed bins of the labellers'
measures, fitted by gradient descent on about `TRAIN_ROWS` documents chosen by a hash of their text. The
scorer then scores every document.

Pattern counts cover all documents; only the scorer's training set is bounded. Null and empty text
has no words, is voted bad and scores low. Equal texts score equally. Other columns are not read; an
empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import slices, window_hashes, windows_of_rows, word_bounds, word_hashes

TRAIN_ROWS = 4000
HASH_BITS = 16
EM_ROUNDS, STEPS, RIDGE = 100, 300, 1e-3
NO_VOTE, BAD, GOOD = 0, 1, 2
#: Measure -> (bad below, good from, good to, bad above). Between them there is no vote.
LABELLERS = {
    "words": (20, 80, np.inf, np.inf),
    "word_length": (3.5, 4.2, 5.9, 6.8),
    "symbols": (-1, 0, 0.02, 0.2),
    "repeated_lines": (-1, 0, 0.01, 0.4),
    "repeated_windows": (-1, 0, 0.05, 0.3),
    "with_letters": (0.8, 0.97, 1, 1),
    "distinct_words": (0.15, 0.4, 1, 1),
    "sentence_ends": (0.004, 0.03, 0.2, 0.4),
}
#: Upper ends of the bins in which the scorer sees a measure.
BINS = {
    "words": (5, 10, 20, 40, 80, 160, 640), "word_length": (3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7), "symbols": (0, 0.02, 0.1, 0.3, 1),
    "repeated_lines": (0, 0.1, 0.3, 0.5, 0.8), "repeated_windows": (0, 0.02, 0.1, 0.3, 0.6), "with_letters": (0.6, 0.8, 0.9, 0.97, 0.999),
    "distinct_words": (0.05, 0.15, 0.3, 0.5, 0.7, 0.9), "sentence_ends": (0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8),
}
_SYMBOL, _LETTER, _END, _HEAD = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LETTER[128:] = True
_END[list(b".!?")] = True
_HEAD[:] = (np.arange(256) & 0xC0) != 0x80  # the bytes at which a code point begins


def _repeats(keys: np.ndarray, row: np.ndarray, at: np.ndarray, size: int, n_words: int, first_word: np.ndarray) -> np.ndarray:
    """Words of each row under windows that the row has twice."""
    order = np.lexsort((keys, row))
    same = (row[order][1:] == row[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n_words + size + 1, np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + size, -1)
    under = np.concatenate([[0], np.cumsum(np.cumsum(edge[:n_words]) > 0)])
    return np.diff(under[first_word])


def measures(texts: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """(first row, last row + 1, measures by name, words' hashes, first word of each row)."""
    for first, last, raw, row_at in slices(texts):
        starts, ends, first_word = word_bounds(raw, row_at)
        words = word_hashes(raw, starts, ends)
        n = np.diff(first_word)
        per_word = np.maximum(n, 1)
        running = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        in_row = lambda mask: np.diff(running(mask)[row_at])
        heads = running(_HEAD[raw])
        by_word = lambda values: np.diff(running(values)[first_word])
        letters = running(_LETTER[raw])
        row = np.repeat(np.arange(len(n)), n)
        at, window_row = windows_of_rows(first_word, 3)
        lines = []
        for text in texts.slice(first, last - first).to_pylist():
            kept = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\f")]
            lines.append((len(kept) - len(set(kept))) / max(len(kept), 1))
        pairs = row.astype(np.int64) << 40 | (words >> np.uint64(24)).astype(np.int64)
        distinct = np.bincount(np.unique(pairs) >> 40, minlength=len(n))
        yield first, last, {
            "words": n.astype(float),
            "word_length": by_word(heads[ends] - heads[starts]) / per_word,
            "symbols": in_row(_SYMBOL[raw]) / per_word,
            "repeated_lines": np.array(lines),
            "repeated_windows": _repeats(window_hashes(words, 3)[at] if len(at) else np.zeros(0, np.uint64), window_row, at, 3, len(words), first_word) / per_word,
            "with_letters": by_word(letters[ends] > letters[starts]) / per_word,
            "distinct_words": distinct / per_word,
            "sentence_ends": by_word(_END[raw[ends - 1]] if len(ends) else np.zeros(0)) / per_word,
        }, words, first_word


def votes(values: dict[str, np.ndarray]) -> np.ndarray:
    """(rows, labellers) of NO_VOTE, BAD and GOOD."""
    columns = []
    for name, (low, good_from, good_to, high) in LABELLERS.items():
        x = values[name]
        good, bad = (x >= good_from) & (x <= good_to), (x < low) | (x > high)
        columns.append(np.where(bad, BAD, np.where(good, GOOD, NO_VOTE)))
    return np.stack(columns, axis=1)


def pattern_of(vote: np.ndarray) -> np.ndarray:
    return vote @ 3 ** np.arange(vote.shape[1])


def estimate(patterns: np.ndarray, counts: np.ndarray, n_labellers: int = len(LABELLERS), rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns with counts.

    Returns the probability of good for each pattern, P(vote | class) as (class, labeller, vote) and the
    share of good documents. Starts from the balance of the votes, so that good is what most call good.
    """
    vote = patterns[:, None] // 3 ** np.arange(n_labellers) % 3
    good = (1.0 + (vote == GOOD).sum(1)) / (2.0 + (vote != NO_VOTE).sum(1))
    table, share = np.zeros((2, n_labellers, 3)), 0.5
    for _ in range(rounds):
        mass = np.stack([counts * (1 - good), counts * good])
        share = (mass[1].sum() + 1) / (mass.sum() + 2)
        for v in (NO_VOTE, BAD, GOOD):
            table[:, :, v] = mass @ (vote == v) + 1
        table /= table.sum(2, keepdims=True)
        log = np.log(table)[:, np.arange(n_labellers), vote].sum(2)
        good = 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - share) - log[1] - np.log(share), -500, 500)))
    return good, table, share


def accuracies(table: np.ndarray, share: float) -> dict[str, float]:
    """Each labeller's share of right votes among its votes."""
    right = share * table[1, :, GOOD] + (1 - share) * table[0, :, BAD]
    wrong = share * table[1, :, BAD] + (1 - share) * table[0, :, GOOD]
    return dict(zip(LABELLERS, right / (right + wrong), strict=True))


def features(values: dict[str, np.ndarray], words: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) entries: the shares of the hashed words, and ones for the bins."""
    n = np.diff(first_word)
    row = np.repeat(np.arange(len(n)), n)
    rows, index, value = [row], [(words >> np.uint64(64 - HASH_BITS)).astype(np.int64)], [1.0 / n[row]]
    for k, (name, upper) in enumerate(BINS.items()):
        rows.append(np.arange(len(n)))
        index.append((1 << HASH_BITS) + 16 * k + np.searchsorted(upper, values[name]))
        value.append(np.ones(len(n)))
    return np.concatenate(rows), np.concatenate(index), np.concatenate(value)


N_FEATURES = (1 << HASH_BITS) + 16 * len(BINS)


def fit(row: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic scorer of soft labels, by Adam on the whole training set."""
    w, bias = np.zeros(N_FEATURES), 0.0
    m, s, n = np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1), max(len(label), 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[index] * value, len(label)) + bias, -50, 50)))
        gap = (p - label) / n
        g = np.append(np.bincount(index, gap[row] * value, N_FEATURES) + RIDGE * w / n, gap.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def train(df: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> dict:
    """The scorer (weights, bias) with what the weak-label model found (accuracies, share of good)."""
    texts = df.select(F.col(text_col).cast("string").alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, values, _, _ in measures(batch.column(0)):
                seen += np.bincount(pattern_of(votes(values)), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["pattern", "n"])

    counts = texts.mapInArrow(tally, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values("pattern")
    patterns, n = counts.pattern.to_numpy(np.int64), counts.n.to_numpy(float)
    good, table, share = estimate(patterns, n)
    total = max(n.sum(), 1.0)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, values, words, first_word in measures(batch.column(0)):
                row, index, value = features(values, words, first_word)
                order = np.argsort(row, kind="stable")
                cut = pa.array(np.searchsorted(row[order], np.arange(last - first + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, last - first), pa.array(pattern_of(votes(values))),
                     pa.ListArray.from_arrays(cut, pa.array(index[order].astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(value[order].astype(np.float32)))],
                    ["key", "pattern", "index", "value"])

    # each text once before it is collected: its copies would all come to the driver
    filled = texts.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    chosen = filled.where(F.pmod("key", F.lit(1 << 30)) < int(min(1.0, train_rows / total) * (1 << 30)))
    chosen = chosen.groupBy("key").agg(F.first("text").alias("text")).select("text", "key")
    rows = chosen.mapInArrow(entries, "key long, pattern long, index array<int>, value array<float>").toPandas()
    rows = rows.sort_values("key")
    posterior = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    if len(rows):
        size = rows["index"].map(len).to_numpy()
        w, bias = fit(np.repeat(np.arange(len(rows)), size), np.concatenate(rows["index"].to_list()), np.concatenate(rows["value"].to_list()).astype(float),
                      rows.pattern.map(posterior).to_numpy(float))
    else:
        w, bias = np.zeros(N_FEATURES), 0.0
    return {"weights": w, "bias": bias, "accuracies": accuracies(table, share), "share": share, "posterior": posterior}


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.5) -> DataFrame:
    """(doc_id, score, kept) of every row: the scorer's probability of good, to six places."""
    w, bias = model["weights"], model["bias"]
    shared = df.sparkSession.sparkContext.broadcast(w)  # N_FEATURES numbers, whatever the corpus

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, values, words, first_word in measures(batch.column(1)):
                row, index, value = features(values, words, first_word)
                z = np.bincount(row, shared.value[index] * value, last - first) + bias
                p = np.round(1 / (1 + np.exp(-np.clip(z, -50, 50))), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(p), pa.array(p >= cutoff)], ["doc_id", "score", "kept"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(apply, "doc_id long, score double, kept boolean")


def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every row of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs))
