"""Compression classifier: held-out accuracy and edge cases."""

import random

from pyspark.sql import functions as F

from ferret.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.op7_quality(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count()
    row = (got.where("held_out").join(labels, "doc_id")
           .agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("acc"),
                F.avg(F.when(F.col("quality") == 1, F.col("predicted"))).alias("kept"),
                F.min("score").alias("lo"), F.max("score").alias("hi")).first())
    assert row.acc > 0.92 and row.kept > 0.97, row
    assert row.lo >= 0 and row.hi <= 1


def test_edges(spark):
    words = ["alpha beta gamma", "delta eps zeta", "eta theta iota kappa"]
    rows = [(i, " ".join(words[(i + j) % 3] for j in range(9)) if i % 2 else "$$$ %%% ### " * (9 + i), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(100, None), (101, ""), (None, "alpha beta"), (1, rows[1][1]),
                                                                 (102, "alpha " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 0), (None, 1), (5, None), (7, 9)], "doc_id long, quality int")
    model = quality.fit(docs, labels.withColumn("text", F.lit("clash")))
    score = quality.scorer(spark, model)
    got = docs.select("doc_id", score(F.col("text")).alias("s")).collect()
    assert len(got) == docs.count() and all(0 <= r.s <= 1 for r in got)
    by = {r.doc_id: r.s for r in got}
    assert by[100] == by[101] and by[9] > by[10]
    one = quality.fit(docs, labels.where("quality = 1"))
    none = quality.fit(docs, labels.limit(0))
    assert quality.scorer(spark, one) and none.offset == 0.0 and one.offset > 0
    assert docs.limit(0).select(score(F.col("text"))).count() == 0


def test_every_part_of_a_long_text_counts():
    rng = random.Random(3)
    text = lambda words, n: "".join(rng.choice(words) + " " for _ in range(n))
    good, bad, other = ([f"{p}{rng.getrandbits(40):x}" for _ in range(5000)] for p in "gbo")
    sizes = quality.Sizes(text(good, 60_000).encode()[:1 << 20], text(bad, 60_000).encode()[:1 << 20])
    passage, filler = text(bad, 25_000), text(other, 300_000)
    assert len(filler) > 3 << 20
    whole = lambda t: sizes(t) * (len(t) + quality.LENGTH_PRIOR)
    alone = whole(passage)
    assert alone < -1000
    assert whole(filler + passage) - whole(filler) < 0.8 * alone
    assert abs(sizes(passage * 20) / sizes(passage) - 1) < 0.1
