"""Cross-entropy difference: counts by brute force, probabilities that sum to one, ordering of texts."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ferret.llm import lm

SF = "/root/testdata/sf0.01"


def test_grams_and_probabilities():
    v = lm.Vocabulary(["a", "b", "é"])
    got = v.grams("A  bÉ\n\nx日")
    sym = [0, 0, 0, 1, 0, 2, 3, 0, 4, 4]
    want = [((sym[i] * 5 + sym[i + 1]) * 5 + sym[i + 2]) * 5 + sym[i + 3] for i in range(len(sym) - 3)]
    assert got.tolist() == want
    counts = np.random.default_rng(1).integers(0, 5, 5 ** 4)
    p = np.exp(lm.log_probs(counts, 5).astype(float)).reshape(-1, 5).sum(1)
    assert np.allclose(p, 1, atol=1e-5)


def test_counts_cover_the_corpus(spark):
    docs = spark.createDataFrame([(1, "abab ba", True), (2, "abc", None), (3, None, True), (4, "", False)], "doc_id long, text string, w boolean")
    v = lm.vocabulary(docs, "text")
    assert v.chars[:2] == ["a", "b"]
    got = {r.gram: (r.n, r.t) for r in lm.gram_counts(docs, v, "text", "w").collect()}
    all_, target = Counter(), Counter()
    for t, w in (("abab ba", True), ("abc", False)):
        all_.update(v.grams(t).tolist())
        target.update(v.grams(t).tolist() if w else [])
    assert got == {g: (n, target[g]) for g, n in all_.items()}


def test_scores(spark):
    got = lm.op8_lm(spark, SF)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert got.count() == docs.count()
    row = got.join(labels, "doc_id").groupBy().agg(F.avg(F.when(F.col("quality") == 1, F.col("ce_difference"))).alias("good"),
                                                   F.avg(F.when(F.col("quality") == 0, F.col("ce_difference"))).alias("bad")).first()
    assert row.good < row.bad


def test_edges(spark):
    docs = spark.createDataFrame([(1, "x" * 200_000, 1), (2, None, 1), (3, "", 1), (None, "a b", 1), (1, "x" * 200_000, 1)], "doc_id long, text string, n_tokens int")
    m = lm.fit(docs.withColumn("w", F.lit(False)), "w")
    got = lm.score(docs, m).collect()
    assert len(got) == 5 and {r.doc_id: r.n_tokens for r in got} == {1: 200_000, 2: 0, 3: 0, None: 3}
    assert lm.score(docs.limit(0), lm.fit(docs.limit(0).withColumn("w", F.lit(True)), "w")).count() == 0


def test_word_models_by_brute_force(spark):
    rows = [(1, "the red fox, the red hen", True), (2, "a blue fox 42", False), (3, "the blue hen", None), (3, "the blue hen", None), (4, "日本 the red", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, w boolean")
    model = lm.fit(docs, "w")
    fresh = [(9, "the red ox ran", False)]
    got = {r.doc_id: r for r in lm.score(docs, model, fitted=True).collect()}
    got |= {r.doc_id: r for r in lm.score(spark.createDataFrame(fresh, docs.schema), model).collect()}
    grams = lambda t: list(zip(["", "", *(x := lm.WORD.findall(t.lower()))], ["", *x], x))
    for column, spelt in (("loss_target", 0), ("loss_background", 1)):
        seen = [g for _, t, w in rows if w or spelt for g in grams(t)]
        c3, c2, c1 = Counter(seen), Counter(g[1:] for g in seen), Counter(g[2] for g in seen)
        h3, h2 = Counter(g[:2] for g in seen), Counter(g[1] for g in seen)
        for k, t, _ in rows + fresh:
            loss = 0.0
            for u, v, w in grams(t):
                p = np.exp((model.spelling.target, model.spelling.background)[spelt][model.spelling.vocab.grams(w + " ")].sum())
                for n, of in ((c1[w], len(seen)), (c2[v, w], h2[v]), (c3[u, v, w], h3[u, v])):
                    p = (n + lm.BACKOFF * p) / (of + lm.BACKOFF)
                loss -= np.log(p)
            assert np.isclose(got[k][column], loss / len(t)), (k, column)


def test_counts_grow_with_the_words(spark):
    # two texts of the same characters in words of other order: only word counts tell them apart
    docs = spark.createDataFrame([(k, "ab cd ef gh" if k % 2 else "gh ef cd ab", bool(k % 2)) for k in range(60)]
                                 + [(100 + k, " ".join(f"w{k}x{j}" for j in range(50)), False) for k in range(20)], "doc_id long, text string, w boolean")
    model = lm.fit(docs, "w")
    assert model.tri.count() > 20 * 100
    by = {r.doc_id: r.ce_difference for r in lm.score(docs, model, fitted=True).collect()}
    assert by[1] < by[0]


def test_blocks_and_buckets_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 3 == 0).alias("w"))
    got = []
    for parts, words in ((1, 10 ** 9), (5, 20_000)):
        monkeypatch.setattr(lm, "BUCKET_TOKENS", words)
        model = lm.fit(docs.repartition(parts), "w")
        assert (model.buckets > 1) == (parts > 1)
        got.append({r.doc_id: (r.n_tokens, r.loss_target, r.loss_background) for r in lm.score(docs, model, fitted=True).collect()})
        fresh = {r.doc_id: (r.n_tokens, r.loss_target, r.loss_background) for r in lm.score(docs.limit(20).repartition(2), model).collect()}
        assert all(np.allclose(x, got[-1][k]) for k, x in fresh.items())
        model.drop()
    assert got[0].keys() == got[1].keys() and all(np.allclose(x, got[1][k]) for k, x in got[0].items())


def test_contexts_cost_next_to_nothing(spark):
    # what a page says of its words and pairs as contexts is little beside their uses (F: op8_lm, disk)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 3 == 0).alias("w"))
    model = lm.fit(docs, "w")
    sent = told = 0
    for r in model.pages().collect():
        sent += len(r["counts"])
        told += 4 + int.from_bytes(r["counts"][:4], "little")
    model.drop()
    assert told < sent < 1.1 * told


def test_counts_come_back_from_a_page():
    rng = np.random.default_rng(5)
    head = rng.random(500) < 0.4
    uses = rng.integers(0, 400, (2, 500))
    # more or fewer uses as a context than uses: the empty word, the last words of texts
    contexts = rng.integers(0, 70_000, (2, head.sum()))
    for u, c, h in ((uses, contexts, head), (uses.astype(np.int32), contexts.astype(np.int32), head), (uses[:, :0], contexts[:, :0], head[:0])):
        got = lm._unpacked(lm._packed(u, c, h), np.append(h, [True, False]))
        assert (got[0] == u).all() and (got[1] == c).all()
