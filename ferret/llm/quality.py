"""Quality by compression: which of two zstandard dictionaries fits a text.

One dictionary is filled with good, one with bad labelled text.  A text is
compressed whole with each, in pieces far smaller than the compressor's window,
so that every piece can refer to the dictionary; the difference of the two
sizes, summed over the pieces, over the text's length is turned into a probability by a logistic curve that is fitted on
labelled texts outside the dictionaries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferret.llm.common import byte_batches, class_sample, crc_mod, stored, table

# The fit uses a bounded sample: about this many labelled rows of each class,
# of texts up to SAMPLE_CHARS characters.
SAMPLE_PER_CLASS = 3000
SAMPLE_CHARS = 20_000
DICT_BYTES = 1 << 20
LEVEL = 3
# Bytes compressed at once: past a window (2 MB) a dictionary is out of reach.
PIECE = 64 << 10
# Added to the length, so that a few bytes of a short text decide little.
LENGTH_PRIOR = 64
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


class Sizes:
    """Normalised difference of compressed sizes: above 0 is nearer to good text."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                                    write_dict_id=False, write_checksum=False))

    def __call__(self, text: str | None) -> float:
        raw = (text or "").encode("utf-8")
        good, bad = (sum(len(c.compress(raw[i:i + PIECE])) for i in range(0, len(raw), PIECE)) for c in self.by)
        return (bad - good) / (len(raw) + LENGTH_PRIOR)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton steps for p = 1 / (1 + exp(-(a x + b))), with a small ridge."""
    m, s = x.mean(), x.std() or 1.0
    z = np.column_stack([(x - m) / s, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - np.array([1e-3, 0]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[0] / s, w[1] - w[0] * m / s


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Dictionaries and curve from ``labels`` (id, 0/1); a row labelled both ways counts as 0.

    Labels other than 0 and 1, and null ids, are ignored.  With only one class
    (or none) there is nothing to compare: every score is that class (0.5).
    """
    # the curve is weighted back to the shares that the classes have in all labels
    lab = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
           .where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y")))
    lab = stored(lab, "quality-labels")
    share = {r.y: r["count"] for r in lab.groupBy("y").count().collect()}
    chosen = stored(class_sample(lab, "y", "id", per_class), "quality-sample")
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .where((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS)).join(chosen, "id")
            .select("y", "text").distinct().withColumn("h", F.xxhash64("text")).collect())
    rows.sort(key=lambda r: (r.h, r.text))
    raw, rest = {0: [], 1: []}, []
    size, half = {0: 0, 1: 0}, {y: sum(r.y == y for r in rows) * 2 // 3 for y in (0, 1)}
    for r in rows:
        # at most two thirds of a class go to its dictionary, the rest fit the curve
        if size[r.y] < DICT_BYTES and len(raw[r.y]) < half[r.y]:
            raw[r.y].append(r.text.encode("utf-8") + b"\n")
            size[r.y] += len(raw[r.y][-1])
        else:
            rest.append(r)
    good, bad = (b"".join(raw[y])[:DICT_BYTES] for y in (1, 0))
    if not good or not bad:
        y = {r.y for r in rows}
        return Model(b"", b"", 0.0, 0.0 if len(y) != 1 else (30.0 if 1 in y else -30.0))
    sizes = Sizes(good, bad)
    y = np.array([float(r.y) for r in rest])
    weight = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum()))
    slope, offset = _logistic(np.array([sizes(r.text) for r in rest]), y, weight * len(y) / weight.sum())
    return Model(good, bad, max(0.0, slope), offset)


def scorer(spark: SparkSession, model: Model):
    """Column function: text column -> score (0 to 1); null counts as the empty text."""
    byte_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality_score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        sizes = Sizes(m.good, m.bad) if m.good else lambda text: 0.0
        for s in texts:
            yield pd.Series([1 / (1 + math.exp(-min(30.0, max(-30.0, m.slope * sizes(t) + m.offset)))) for t in s],
                            dtype="float64")

    def apply(text: Column) -> Column:
        return quality_score(text)

    return apply


def fold_model(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the held-out protocol: rows with crc32(id) mod 5 = 0 teach nothing."""
    return fit(docs, labels.where(crc_mod("doc_id", 5) != 0))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = scorer(spark, fold_model(spark, docs, table(spark, sf_dir, "labels")))
    return (docs.select("doc_id", score(F.col("text").cast("string")).alias("score"))
            .select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
