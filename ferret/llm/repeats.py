"""Removal of byte strings that occur more than once, within or across texts.

A sparse suffix order in place of a dense one: every window of ``SIZE`` bytes
belongs to the position (anchor) of its smallest GRAM-byte fingerprint, so equal
windows have equal anchors at equal offsets.  Runs of windows with one anchor
are compared whole first: an equal run elsewhere makes all its windows
repeats, an anchor without another occurrence makes none.  What is between is
cut into cells of offsets, tested the same way, and only cells at the edge of
a repeat are resolved window by window.  All comparisons are grouped counts of
fingerprints, so a passage that fills a third of the corpus is counted, never
gathered or paired.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferret.llm.common import BIN, INT, LONG, byte_batches, mix64, schema, shipped, stored, table, text_or_empty

SIZE = 200
GRAM = 32
CELL = 16
BASE = 0x9E3779B97F4A7C15 | 1
C1, C2, C3 = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


class Prints:
    """Fingerprints of any part of a byte string, from one running sum."""

    powers = inverse = np.ones(1, np.uint64)
    bytes_ = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

    def __init__(self, raw: bytes):
        n = len(raw)
        if len(Prints.powers) <= n:
            size = 1 << n.bit_length()
            for name, base in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(Prints, name, np.multiply.accumulate(x))
        self.n = n
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(Prints.bytes_[np.frombuffer(raw, np.uint8)] * Prints.powers[:n], out=self.sums[1:])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * Prints.inverse[start])


class Runs:
    """The anchors of a text: runs of windows (first..last start) whose smallest fingerprint is at ``at``."""

    def __init__(self, raw: bytes):
        self.prints = p = Prints(raw)
        empty = np.empty(0, np.int64)
        self.at = self.first = self.last = empty
        self.key = self.whole = empty.astype(np.uint64)
        if p.n < SIZE:
            return
        starts = np.arange(p.n - GRAM + 1)
        gram = p.part(starts, starts + GRAM)
        best, where, width, need = gram, starts, 1, SIZE - GRAM + 1
        while width < need:
            step = min(width, need - width)
            left = best[:-step] <= best[step:]
            where = np.where(left, where[:-step], where[step:])
            best = np.where(left, best[:-step], best[step:])
            width += step
        cut = np.flatnonzero(np.diff(where)) + 1
        self.first = np.concatenate([[0], cut])
        self.last = np.concatenate([cut - 1, [len(where) - 1]])
        self.at = where[self.first]
        self.key = gram[self.at]
        low, high = (self.at - self.last).astype(np.uint64), (self.at - self.first).astype(np.uint64)
        self.whole = mix64(p.part(self.first, self.last + SIZE) ^ (low * C1) ^ (high * C2))

    def cells(self, ords: np.ndarray) -> tuple[np.ndarray, ...]:
        """(ord, cell, least offset, largest offset) of all cells of the given runs."""
        low, high = self.at[ords] - self.last[ords], self.at[ords] - self.first[ords]
        n = high // CELL - low // CELL + 1
        of = np.repeat(np.arange(len(ords)), n)
        cell = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + (low // CELL)[of]
        return ords[of], cell, np.maximum(low[of], cell * CELL), np.minimum(high[of], cell * CELL + CELL - 1)

    def limits(self, ords: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (np.maximum(self.at[ords] - self.last[ords], cell * CELL),
                np.minimum(self.at[ords] - self.first[ords], cell * CELL + CELL - 1))


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uid, key, whole, ords = [], [], [], []
        for u, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            r = Runs(text)
            uid.append(np.full(len(r.at), u, np.int64))
            key.append(r.key)
            whole.append(r.whole)
            ords.append(np.arange(len(r.at), dtype=np.int32))
        if uid:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(uid)), _i64(np.concatenate(key)), _i64(np.concatenate(whole)),
                                              pa.array(np.concatenate(ords))], names=["uid", "gram", "whole", "ord"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, text, ords) -> fingerprints of what all windows of a cell share and of all that they cover."""
    for batch in batches:
        out = []
        for u, text, ords in zip(*(c.to_pylist() for c in batch.columns)):
            r = Runs(text)
            o, cell, low, high = r.cells(np.array(sorted(set(ords)), np.int64))
            at = r.at[o]
            core = mix64(r.prints.part(at - cell * CELL, at - cell * CELL - CELL + 1 + SIZE) ^ (r.key[o] * C3) ^ (cell.astype(np.uint64) * C1))
            span = mix64(r.prints.part(at - high, at - low + SIZE) ^ (low.astype(np.uint64) * C1) ^ (high.astype(np.uint64) * C2))
            out.append((core, span, np.full(len(o), u, np.int64), o.astype(np.int32), cell.astype(np.int32)))
        if out:
            core, span, uid, o, cell = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([_i64(core), _i64(span), pa.array(uid), pa.array(o), pa.array(cell)],
                                             names=["core", "span", "uid", "ord", "cell"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, text, ords, cells, open) -> fingerprint of every window of the cells."""
    for batch in batches:
        out = []
        for u, text, ords, cells, opened in zip(*(c.to_pylist() for c in batch.columns)):
            r = Runs(text)
            o, cell = np.array(ords, np.int64), np.array(cells, np.int64)
            low, high = r.limits(o, cell)
            n = high - low + 1
            start = np.repeat(r.at[o] - high, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((r.prints.part(start, start + SIZE), np.full(len(start), u, np.int64), start.astype(np.int32), np.repeat(np.array(opened, bool), n)))
        if out:
            win, uid, start, opened = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([_i64(win), pa.array(uid), pa.array(start), pa.array(opened)], names=["win", "uid", "start", "open"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, text, marks) -> what is left of the text, and the removed spans."""
    for batch in batches:
        kept, spans = [], []
        for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            r = Runs(text)
            o, x = (np.array([m[k] for m in marks], np.int64) for k in ("ord", "x"))
            run, cell = (o >= 0) & (x < 0), (o >= 0) & (x >= 0)
            low, high = r.limits(o[cell], x[cell])
            first = np.concatenate([r.first[o[run]], r.at[o[cell]] - high, x[o < 0]])
            last = np.concatenate([r.last[o[run]], r.at[o[cell]] - low, x[o < 0]])
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, last + SIZE, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            step = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(step[::2], step[1::2])])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(
            spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["uid", "kept", "spans"])


SPANS = T.ArrayType(schema(start=LONG, end=LONG))


def _ids(docs: DataFrame, text_col: str) -> int:
    """A seed for which no two different texts of the table have one 64-bit id."""
    for seed in count(1):
        x = docs.select(text_id(text_col, seed).alias("uid"), F.xxhash64(F.lit(-seed), text_or_empty(text_col)).alias("check"))
        if x.groupBy("uid").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").isEmpty():
            return seed


def text_id(text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), text_or_empty(text_col))


def repeated_spans(docs: DataFrame, seed: int, text_col: str = "text") -> DataFrame:
    """(uid, kept, spans) of every distinct text that holds a repeat; ``kept`` are the bytes left."""
    spark = docs.sparkSession
    byte_batches(spark)
    texts = docs.select(text_id(text_col, seed).alias("uid"), text_or_empty(text_col).cast("binary").alias("text")).where(F.length("text") >= SIZE)
    # 1. runs: whole equal runs, and anchors that occur once
    runs = stored(texts.mapInArrow(_anchors, schema(uid=LONG, gram=LONG, whole=LONG, ord=INT)), "repeats-runs")
    # (counts are written before they are joined back: a join of two plain tables
    # lets Spark split the rows of a very common fingerprint over tasks)
    twice = (runs.groupBy("gram").agg(F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
             .where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("mixed")))
    twice = stored(twice, "repeats-twice")
    some = stored(runs.join(twice, "gram"), "repeats-some")
    same = (some.where("mixed").groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("uid", "ord")).alias("lead")))
    same = stored(same, "repeats-same")
    mixed = stored(some.where("mixed").join(same, ["gram", "whole"])
                   .select("uid", "ord", (F.col("n") > 1).alias("full"), (F.struct("uid", "ord") == F.col("lead")).alias("lead")).distinct(), "repeats-mixed")
    marks = some.where("not mixed").select("uid", "ord").unionByName(mixed.where("full").select("uid", "ord")).distinct()
    marks = marks.select("uid", "ord", F.lit(-1).alias("x"))
    # the texts that take part, one row each, laid out by id for the three steps that read them
    ids = stored(some.select("uid").distinct(), "repeats-texts")
    name = f"ferret_repeats_texts_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (texts.join(shipped(ids), "uid", "left_semi").repartition(parts, "uid").dropDuplicates(["uid"])
     .write.format("parquet").option("compression", "zstd").bucketBy(parts, "uid").saveAsTable(name))
    texts = spark.table(name)
    # 2. cells of runs that are neither: one of each set of equal runs stands for all
    asked = mixed.where("lead").groupBy("uid").agg(F.collect_list("ord").alias("ords"))
    cells = texts.join(asked, "uid").select("uid", "text", "ords").mapInArrow(_cells, schema(core=LONG, span=LONG, uid=LONG, ord=INT, cell=INT))
    by_core, by_span = Window.partitionBy("core"), Window.partitionBy("core", "span")
    cells = (cells.withColumn("a", F.min("span").over(by_core)).withColumn("b", F.max("span").over(by_core)).withColumn("c", F.count("*").over(by_core))
             .where("c > 1").withColumn("n", F.count("*").over(by_span)).withColumn("k", F.row_number().over(by_span.orderBy("uid", "ord"))))
    cells = stored(cells.select("uid", "ord", "cell", (F.col("n") > 1).alias("full"), (F.col("a") != F.col("b")).alias("mixed"), "k"), "repeats-cells")
    marks = marks.unionByName(cells.where("full").select("uid", "ord", F.col("cell").alias("x")))
    # 3. windows of cells at the edge of a repeat
    edge = cells.where("mixed and k = 1").select("uid", F.struct("ord", "cell", (~F.col("full")).alias("open")).alias("c"))
    edge = edge.groupBy("uid").agg(F.collect_list("c").alias("c"))
    wins = (texts.join(edge, "uid").select("uid", "text", F.col("c.ord").alias("ords"), F.col("c.cell").alias("cells"), F.col("c.open").alias("open"))
            .mapInArrow(_windows, schema(win=LONG, uid=LONG, start=INT).add("open", T.BooleanType())))
    wins = wins.withColumn("n", F.count("*").over(Window.partitionBy("win"))).where("n > 1 and open")
    marks = marks.unionByName(wins.select("uid", F.lit(-1).alias("ord"), F.col("start").alias("x")))
    # 4. removal, text by text
    marks = stored(marks, "repeats-marks").groupBy("uid").agg(F.collect_list(F.struct("ord", "x")).alias("marks"))
    out = texts.join(marks, "uid").select("uid", "text", "marks").mapInArrow(
        _remove, T.StructType([T.StructField("uid", LONG), T.StructField("kept", BIN), T.StructField("spans", SPANS)]))
    return stored(out, "repeats-kept")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, kept, spans) of every row.

    Removes each byte covered by a ``SIZE``-byte string that also starts
    anywhere else in the table, the same text included; all strings are judged
    on the input.  Texts are their UTF-8 bytes and matches never cross texts.
    Null texts are empty; rows of equal text repeat each other; shorter texts
    stay whole.  Only the two named columns are read.
    """
    seed = _ids(docs, text_col)
    text = text_or_empty(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_id(text_col, seed).alias("uid"), text.alias("text"))
    found = repeated_spans(docs, seed, text_col)
    hit = stored(found.select("uid").distinct(), "repeats-hit")
    clean = rows.join(shipped(hit), "uid", "left_anti").select(
        "doc_id", F.length("text").cast("long").alias("n_bytes"), F.col("text").alias("kept"), F.array().cast(SPANS).alias("spans"))
    cut = rows.select("doc_id", "uid", F.length("text").cast("long").alias("n_bytes")).join(found, "uid").select("doc_id", "n_bytes", "kept", "spans")
    return clean.unionByName(cut)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
