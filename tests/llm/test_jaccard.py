"""Jaccard join against brute force: sets, components, tree bounds."""

import pickle
import random

import numpy as np
import xxhash

from ferret.llm import jaccard


def shingles(t):
    ws = (t or "").translate({i: i + 32 for i in range(65, 91)})
    ws = [w for w in __import__("re").split("[\x20\x09-\x0D]+", ws) if w]
    return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in docs if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted([(d, len(s), find(d) if d is not None else None) for d, s in sets], key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["\u00c9t\u00e9", "The"]
    passage = [rng.choice(vocab) for _ in range(60)]
    docs = []

    def add(ws):
        docs.append((len(docs) * 3 + 1, " ".join(ws)))

    for size in (3, 5, 8, 30, 120, 400, 2500):
        for _ in range(3):
            base = [rng.choice(vocab) for _ in range(size)]
            add(base)
            for edits in (0, 1, 2, size // 60, size // 25, size // 12):
                ws = list(base)
                for _ in range(edits):
                    ws[rng.randrange(len(ws))] = rng.choice(vocab)
                add(ws)
            add(base[:int(size * 0.9)])
            add(base[:int(size * 0.8)])
    for _ in range(40):
        add([rng.choice(vocab) for _ in range(12)] + passage + [rng.choice(vocab) for _ in range(rng.randrange(0, 30))])
    for k in range(30):
        add(["the"] * (k + 1))
    docs += [(5000, None), (5001, ""), (5002, " \n"), (None, docs[0][1]), (docs[4][0], docs[4][1]), (5003, docs[4][1].upper()), (5004, "A  b\tC"), (5005, "a b c")]
    rng.shuffle(docs)
    return docs


def test_brute(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, node string")
    got = sorted([tuple(r) for r in jaccard.similar_components(df).collect()], key=str)
    assert got == brute(docs)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_components(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.similar_components(df).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


def test_dual_traversal_loses_no_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = []
    for k in range(150):
        size = int(rng.integers(20, 900))
        own = base[:size] if k % 3 else rng.integers(0, 1 << 63, size).astype(np.uint64)
        keep = rng.random(size) > (0.1 if k % 2 else 0.02)
        sets.append(np.unique(own[keep]))
    node = np.arange(len(sets))
    n = np.array([len(s) for s in sets])
    a, b, best = jaccard._match(node, n, node, [jaccard.bitmap(s) for s in sets], 80)
    got = set(zip(a.tolist(), b.tolist()))
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (n[i] + n[j] - both):
                want.add((j, i))
    assert want and want <= got and len(got) < len(sets) ** 2 / 8
    assert best.any()
    # the bound of a pair is the one of the trees, and never below the truth
    for i, j in [(3, 6), (0, 9), (30, 100), (12, 140)]:
        most = jaccard.largest_overlap(int(n[i]), int(n[j]), jaccard.bitmap(sets[i]), jaccard.bitmap(sets[j]))
        assert most >= len(np.intersect1d(sets[i], sets[j]))
        fits = 180 * most >= 80 * (n[i] + n[j]) and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j])
        assert ((min(i, j), max(i, j)) in got) == fits


def test_trees_alone_and_pairs_alone(spark, monkeypatch):
    docs = [d for d in corpus(11) if d[0] is not None][:160]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for few in (1, 10_000):
        monkeypatch.setattr(jaccard, "FEW", few)
        assert sorted([tuple(r) for r in jaccard.similar_components(df).collect()], key=str) == brute(docs)


def test_a_worker_keeps_no_words():
    # pipeline: a table of a million known words in every worker filled the executors
    shingles = jaccard.Shingler()
    held = lambda: len(pickle.dumps(vars(shingles)))
    before = held()
    for k in range(50):
        shingles(" ".join(f"w{k}x{j}" for j in range(200)))
    assert held() == before
    few = shingles("Ab c")
    want = jaccard.mix64((np.array([xxhash.xxh3_64_intdigest(w) for w in (b"ab", b"c")], np.uint64) * shingles.weights[:2])
                         .sum(dtype=np.uint64, keepdims=True) ^ jaccard.SEEDS[[0]] * np.uint64(2))
    assert few.tolist() == want.tolist()


def test_common_shingles_come_last(spark):
    # pipeline and op5 on 6 GB: a line of a tenth of all texts made one group of them, 10 GB of node pairs in one worker
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(vocab) for _ in range(14))
    docs = []
    for d in range(0, 1200, 2):
        own = [rng.choice(vocab) for _ in range(20 + d % 31)]
        docs.append((d, " ".join(own) + " . " + line))
        if d % 40 == 0:  # a near copy
            docs.append((d + 1, " ".join(own[:-1]) + " . " + line))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    common = jaccard.common_shingles(df, 5, "text")
    h = jaccard.Shingler()(". " + line)
    assert set(common.tolist()) == set(h.tolist())
    sets = jaccard.shingle_sets(df, 5, 80, "doc_id", "text").collect()
    held = [len(set(r.prefix) & set(h.view(np.int64).tolist())) for r in sets]
    assert not any(held) and all(len(r.prefix) == jaccard.prefix_size(r.n) for r in sets)
    assert sorted([tuple(r) for r in jaccard.similar_components(df).collect()], key=str) == brute(docs)


def test_common_shingles_hold_whole_texts(spark, monkeypatch):
    # where all shingles of a text are common, the order among them keeps every link
    monkeypatch.setattr(jaccard, "COUNTED", 1)
    for common, most in ((1, 50_000), (3, 40)):
        monkeypatch.setattr(jaccard, "COMMON", common)
        monkeypatch.setattr(jaccard, "COMMONS", most)
        docs = [d for d in corpus(5) if d[0] is not None][:150]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert sorted([tuple(r) for r in jaccard.similar_components(df).collect()], key=str) == brute(docs)


def test_dual_traversal_holds_few_pairs_at_once():
    import tracemalloc

    # no pair of upper nodes can be excluded, few pairs of sets are one
    rng = np.random.default_rng(1)
    sig = np.zeros((6000, 1), np.uint64)
    for _ in range(16):
        sig[:, 0] |= np.uint64(1) << rng.integers(0, 64, len(sig)).astype(np.uint64)
    sig[-5:] = sig[:5]
    tree = jaccard.Tree(sig, np.bitwise_count(sig).sum(axis=1).astype(np.int64), np.arange(len(sig)))
    tracemalloc.start()
    a, b, _ = jaccard.dual(tree, tree, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(k, 5995 + k) for k in range(5)} <= set(zip(a.tolist(), b.tolist())) and len(a) < 100 and (a < b).all()
    assert peak < 30e6
