"""Decontamination against a brute-force scan, and proximity matches."""

import hashlib
import re

from ferret.llm import decontam

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for item, t in items:
            bs = words(t)
            if item is None or not bs:
                continue
            m = min(n, len(bs))
            for w in {tuple(bs[i:i + m]) for i in range(len(bs) - m + 1)}:
                for i in range(len(ws) - m + 1):
                    if tuple(ws[i:i + m]) == w:
                        hit |= set(range(i, i + m))
                        found.add(str(item))
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


BASE = "the Quick brown fox jumps over the lazy dog while É rain falls"
ITEMS = [(1, BASE), (2, "short one"), (3, None), (4, "  ,, "), (None, "brown fox"), (10, BASE), (5, "the the the the the the the the the the the"), (6, "ÉTÉ long")]
DOCS = [(1, "x " + BASE.upper().replace("É", "É") + " y"), (2, "Short, one! short one two"), (3, None), (4, ""), (5, "the " * 300),
        (6, " quick brown fox jumps over the lazy dog while É rain"), (7, "a short\none"), (7, "a short\none"), (7, "nothing here"),
        (None, "short one"), (None, None), (8, "Été long"), (9, "ÉtÉ LONG"), (11, "w " * 30000 + BASE)]


def test_brute(spark, monkeypatch):
    docs = spark.createDataFrame([(a, b, 1, "z") for a, b in DOCS], "doc_id long, text string, pos int, tid string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(decontam, "table", lambda s, d, n: docs if n == "documents" else items)
    got = sorted([tuple(r) for r in decontam.op1_decontam(spark, "").collect()], key=str)
    assert got == brute(DOCS, ITEMS)


def test_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0))):
        monkeypatch.setattr(decontam, "table", lambda s, _, n, d=d, i=i: d if n == "documents" else i)
        got = decontam.op1_decontam(spark, "").collect()
        assert len(got) == d.count() and not any(r.contaminated for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "fox a b quick c brown"), (2, "quick " + "x " * 9 + "brown fox"), (3, "quick brown")], "doc_id long, text string")
    wins = decontam.windows(spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string"))
    index = decontam.build_index(docs)
    assert [r.doc_id for r in decontam.proximity(index, wins, 5).collect()] == [1]
    assert {r.doc_id for r in decontam.proximity(index, wins, 20).collect()} == {1, 2}
