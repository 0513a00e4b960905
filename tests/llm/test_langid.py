"""Language identification: exact forward sums, held-out accuracy, edge cases."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from ferret.llm import langid
from ferret.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def brute(pieces, probs, word, lang):
    """Sum over every way to cut the marked word."""
    w = "\u2581" + word
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(w) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
        p = 1.0
        for a, b in zip(at, at[1:]):
            x = w[a:b]
            p *= probs[pieces.index(x), lang] if x in pieces else (langid.UNSEEN if len(x) == 1 else 0.0)
        total += p
    return math.log(total)


def test_forward_sums_all_segmentations_and_counts_match():
    pieces = ["\u2581", "\u2581a", "a", "b", "ab", "ba", "aba", "\u2581ab"]
    rng = np.random.default_rng(1)
    probs = np.vstack([rng.random((len(pieces), 2)), [[langid.UNSEEN] * 2]])
    lattice, words = langid.Lattice(pieces), ["a", "abab", "bz", "ababab", "baba"]
    got = langid.forward(lattice, words, probs)
    for k, w in enumerate(words):
        for lang in (0, 1):
            assert abs(got[k, lang] - brute(pieces, probs, w, lang)) < 1e-9
    # expected uses times piece lengths cover every character of every word
    counts, langs = np.array([1.0, 2, 1, 3, 1]), np.array([0, 1, 0, 1, 0])
    uses = langid.expected(lattice, words, counts, langs, probs)
    size = np.array([len(p) for p in pieces] + [1])[:, None]
    for lang in (0, 1):
        assert abs((uses * size)[:, lang].sum() - sum(c * (len(w) + 1) for w, c, x in zip(words, counts, langs) if x == lang)) < 1e-6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op4_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    row = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("a"),
                                    F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert row.a > 0.97 and row.lo >= 0 and row.hi <= 1
    assert got.count() == docs.count()


def test_edges_and_no_training_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", None),
            (5, "123 !! _", "fr"), (6, "z" * 100_000 + " le chat", None), (None, "the dog", None), (1, "the cat and the dog", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = langid.predict(docs, langid.fit(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[k].lang_pred for k in (1, 2, 3, 4, 5, None)] == ["en", "fr", "und", "und", "und", "en"]
    assert by[3].score == 0 and by[6].lang_pred in ("en", "fr")
    none = langid.fit(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), none).count() == 0
    assert crc_mod("doc_id", 4) is not None
