"""Periodic runs of words, by seeds on diagonals.

A run of period q and length at least ``max(min_length, copies * q)`` repeats
itself q words later over at least ``max(min_length - q, (copies - 1) * q)``
words.  Lags are cut into bands, and each band has one gram length k that every
run of the band is sure to hold on its diagonal.  The k-grams of a text are
indexed, each occurrence is paired with the next one in the same text, pairs
whose lag lies in the band are seeds, and a seed is extended along its diagonal
in both directions.  A table of how far each lag is already covered keeps a
stretch from being extended again.

Bands are made so that the pairs of neighbouring occurrences are enough (lags
of a band are at most 2k/3): if a k-gram w of a run of smallest period q came
again less than q words later, w would have two periods that together do not
exceed k, hence their common divisor as a period, and so would the run.  So no
pair but the next one is ever made, and a text of one repeated word costs no
more than any other.  Grams that occur once are dropped at each band; what is
left is named exactly for the next band by the names of its two halves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferret.llm.common import LONG, STR, byte_batches, mix64, schema, table, text_or_empty

MIN_LENGTH = 24
COPIES = 3
# Bytes of text searched at once in a task: bounds its arrays (one text is never cut).
TOGETHER = 4 << 20
C1 = np.uint64(0x9E3779B97F4A7C15)

RUNS = T.ArrayType(schema(start=LONG, length=LONG, period=LONG))


def bands(min_length: int, copies: int) -> Iterator[tuple[int, int, int]]:
    """(k, least lag, largest lag) of each band, without end."""
    if copies < 3:
        raise ValueError("runs of fewer than three copies are not found by neighbouring occurrences")
    sure = [max(min_length - q, (copies - 1) * q) for q in range(1, min_length + 1)]
    k, low = min(sure), 1
    while True:
        yield k, low, 2 * k // 3
        low = 2 * k // 3 + 1
        k = 2 * low


def _named(pos: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Occurrences that have another of the same key in their text, in the order (key, position), and their names."""
    if not len(pos):
        return pos, key
    order = np.argsort(key, kind="stable")
    pos, key = pos[order], key[order]
    same = (key[1:] == key[:-1]) & (doc[pos[1:]] == doc[pos[:-1]])
    again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    name = np.cumsum(np.concatenate([[True], ~same]))
    return pos[again], name[again]


def _grams(words: np.ndarray, doc: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, names) of the k-grams that occur again in their text; found by fingerprints, verified word by word."""
    pos = np.flatnonzero(np.arange(len(words)) + k <= end)
    for seed in count(1):
        h, width = mix64(words.astype(np.uint64) + np.uint64(seed) * C1), 1
        while width < k:
            step = min(width, k - width)
            h = np.concatenate([mix64(h[:-step] * C1 + h[step:]), h[-step:]])
            width += step
        found, name = _named(pos, h[pos], doc)
        a, b = found[:-1][name[1:] == name[:-1]], found[1:][name[1:] == name[:-1]]
        if all((words[a + i] == words[b + i]).all() for i in range(k)):
            return found, name


def find_runs(words: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH, copies: int = COPIES) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each of several texts; ``words`` holds their word numbers one after another."""
    ends = np.cumsum(sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pos = name = None
    for k, low, high in bands(min_length, copies):
        if pos is None:
            if not (sizes >= min_length).any():
                return out
            pos, name = _grams(words, doc, ends[doc], k)
        else:
            # a gram of this band is two overlapping ones of the last band
            order = np.argsort(pos)
            pos, name = pos[order], name[order]
            at = np.searchsorted(pos, pos + (k - last))
            at[at == len(pos)] = 0
            both = (pos[at] == pos + (k - last)) & (doc[pos[at]] == doc[pos])
            key = name[both] * (name.max(initial=0) + 1) + name[at[both]]
            pos, name = _named(pos[both], key, doc)
        last = k
        if not len(pos):
            return out
        near = (name[1:] == name[:-1]) & (pos[1:] - pos[:-1] >= low) & (pos[1:] - pos[:-1] <= high)
        seed, lag = pos[:-1][near], (pos[1:] - pos[:-1])[near]
        order = np.lexsort((seed, lag))
        seed, lag = seed[order], lag[order]
        # neighbouring seeds of one lag are one stretch
        first = np.flatnonzero(np.concatenate([[True], (np.diff(seed) != 1) | (np.diff(lag) != 0)])[:len(seed)])
        final = np.concatenate([first[1:], [len(seed)]])[:len(first)] - 1
        covered: dict[tuple[int, int], int] = {}
        for i, j, q in zip(seed[first].tolist(), seed[final].tolist(), lag[first].tolist()):
            d = int(doc[i])
            if j < covered.get((d, q), 0):
                continue
            begin, stop = int(ends[d] - sizes[d]), int(ends[d])
            s, e = i, j + k
            while s > begin and words[s - 1] == words[s - 1 + q]:
                s -= 1
            while e + q < stop and words[e] == words[e + q]:
                e += 1
            covered[d, q] = e
            if e + q - s >= max(min_length, copies * q):
                out[d].append((s - begin, e + q - s, q))


def _search(min_length: int, copies: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def answer(ids: list, texts: list) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        words = [t.encode("utf-8").split() for t in texts]  # splits at the blanks of ASCII alone
        flat = np.array([number.setdefault(w, len(number)) for x in words for w in x], np.int64)
        found = find_runs(flat, np.array([len(x) for x in words], np.int64), min_length, copies)
        runs, kept = [], []
        for x, r in zip(words, found):
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in sorted(r, key=lambda v: (v[0], v[2]))])
            gone = np.zeros(len(x), bool)
            for s, n, q in r:
                gone[s + q:s + n] = True
            kept.append(b" ".join([w for w, g in zip(x, gone.tolist()) if not g] if r else x).decode("utf-8"))
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(x) for x in words], pa.int64()),
            pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
            pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and size + len(t) > TOGETHER:
                yield answer(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield answer(ids, texts)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, copies: int = COPIES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``.  ``runs`` are the maximal stretches of
    words with smallest period q and at least ``min_length`` words and
    ``copies`` periods, ordered by start, then period; runs may overlap.
    ``collapsed`` holds the words that stand in no run after its first period,
    joined by one space.  Null, empty and blank texts have no words, no runs
    and an empty result; repeated rows and null ids are answered as they are;
    an empty table gives no rows.  Ids are cast to long.  Only the two named
    columns are read, so no other column can clash.  A text is searched whole
    in one task, at some 150 bytes a word (a text of 100 MB needs 2.5 GB).
    """
    byte_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _search(min_length, copies, it), T.StructType([
        T.StructField("doc_id", LONG), T.StructField("n_words", LONG), T.StructField("runs", RUNS), T.StructField("collapsed", STR)]))




def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for h, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            x = t.encode("utf-8").split() if h is not None and h % 10 == 0 else []
            if x:
                g, n = h // 10, len(x)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                t = b" ".join([*x[:a], *[x[a + (i - a) % p] for i in range(a, n)]]).decode("utf-8")
            texts.append(t)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def planted(docs: DataFrame) -> DataFrame:
    """``documents`` with every tenth text (by crc32 of its id) made periodic from some word on."""
    byte_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(_plant, schema(doc_id=LONG, text=STR))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(planted(table(spark, sf_dir, "documents")))
    # runs are in order, so a later one of the same exponent does not replace the first
    best = F.expr("aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), "
                  "(m, r) -> if(m is null or r.length * m.period > m.length * r.period, r, m))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    out = out.select("doc_id", "n_words", "runs", "collapsed", best.alias("best"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
