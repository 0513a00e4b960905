"""Removal of repeated strings against brute force."""

import hashlib
import random
from collections import Counter

from ferret.llm import repeats

SF = "/root/testdata/sf0.001"


def brute(docs, size=200):
    seen = Counter()
    raws = [(d, (t or "").encode()) for d, t in docs]
    for _, b in raws:
        seen.update(b[i:i + size] for i in range(len(b) - size + 1))
    out = []
    for d, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, monkeypatch, df):
    monkeypatch.setattr(repeats, "table", lambda *_: df)
    return sorted([tuple(r) for r in repeats.op10_repeats(spark, "").collect()], key=str)


def test_made_texts(spark, monkeypatch):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdeé fghij") for _ in range(n))
    passage, base = text(600), text(3000)
    docs = [text(900) + passage + text(300), passage[50:], passage[:195] + text(10), text(100) + passage[200:450] + text(500) + passage[100:310]]
    for _ in range(25):
        x = list(base)
        for _ in range(rng.randrange(1, 9)):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        docs.append("".join(x))
    docs += [base, base, "ab" * 300, "ab" * 101, "De " * 700, "z" * 199, "z" * 200, "q" * 201, "", None, text(200), "n" * 40_000 + text(300)]
    part = text(199)
    docs += [part + "1" + text(60), part + "2" + text(60), "3" + part + "1"]
    rows = [(k, t) for k, t in enumerate(docs)] + [(2, docs[2]), (None, docs[0]), (None, None)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, uid int")
    assert run(spark, monkeypatch, df) == brute(rows)
    assert run(spark, monkeypatch, df.limit(0)) == []


def test_table(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert run(spark, monkeypatch, df) == brute(rows)
