"""Embedding near-duplicates against brute force."""

import numpy as np
from pyspark.sql import functions as F

from ferret.llm import vectors

SF = "/root/testdata/sf0.1"


def brute(rows, threshold=0.93):
    ids = [r[0] for r in rows]
    root, n = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [(i, lab, np.array(v, float)) for i, v, lab in rows if v and lab is not None and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    for a, (i, la, x) in enumerate(good):
        for j, lb, y in good[:a]:
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[i] += 1
                n[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (n[i], find(i), find(i) == i) for i in ids}


def test_small_cases(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows, base = [], rng.normal(size=(6, 8))
    for k in range(120):
        v = (base[k % 6] + rng.normal(size=8) * 0.12 * (k % 4)).astype(np.float32).tolist()
        rows.append((k * 2, v, k % 3))
    rows += [(1001, rows[0][1], rows[0][2]), (1003, rows[0][1], 99), (1005, None, 1), (1007, [0.0] * 8, 1), (1009, [1.0, None] * 4, 1),
             (1011, [float("nan")] * 8, 1), (1013, rows[0][1], None), (1015, [], 1), (1017, [1.0, 2.0, 3.0], 0), (1019, [2.0, 4.0, 6.0], 0),
             (1021, [float("inf")] * 8, 0), (1023, [5.0], 2), (1025, [7.0], 2)]
    monkeypatch.setattr(vectors, "BLOCK", 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert got == brute(rows)
    empty = vectors.near_duplicates(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]
    odd = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted([tuple(r) for r in vectors.near_duplicates(odd).collect()], key=str) == [(1, 0, 1, True), (None, 0, None, False)]


def test_recall_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.op6_vectors(spark, SF).collect()}
    assert set(got) == set(want) and all(got[k][0] <= want[k][0] for k in want)
    assert sum(v[0] for v in got.values()) >= 0.95 * sum(v[0] for v in want.values())
    assert np.mean([got[k] == want[k] for k in want]) > 0.95


def _made(rng, hot, pairs, alone, dims=64):
    unit = lambda x: x / np.sqrt((x * x).sum(-1, keepdims=True))
    group = unit(unit(rng.normal(size=dims)) + rng.normal(size=(hot, dims)) * 0.002)
    a = unit(rng.normal(size=(pairs, dims)))
    d = rng.normal(size=(pairs, dims))
    d = unit(d - (d * a).sum(1, keepdims=True) * a)
    c = rng.uniform(0.935, 0.97, size=(pairs, 1))
    return np.concatenate([group, a, c * a + np.sqrt(1 - c * c) * d, unit(rng.normal(size=(alone, dims)))])


def _distinct(spark, x):
    return spark.createDataFrame([(0, i, 1, v.tolist(), hash(i)) for i, v in enumerate(x)], "label long, node long, c long, v array<double>, h2 long")


def test_cells_are_not_decided_by_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CELL", 16)
    hot, pairs = 1000, 1000
    x = _made(np.random.default_rng(5), hot, pairs, 0)
    grid = vectors.fit(_distinct(spark, x), vectors.COSINE)
    a, b = x[hot:hot + pairs], x[hot + pairs:]
    assert len(grid.books[64][0]) * len(grid.books[64][1]) > 100 and grid.cells > 4
    met = (grid.visit(a, grid.cells) == grid.own(b)[:, None]).any(1) | (grid.visit(b, grid.cells) == grid.own(a)[:, None]).any(1)
    assert met.mean() >= 0.99


def test_all_cells_without_links(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CELL", 16)
    grid = vectors.fit(_distinct(spark, _made(np.random.default_rng(6), 0, 0, 1500)), vectors.COSINE)
    assert grid.cells == len(grid.books[64][0]) * len(grid.books[64][1]) > 4
