"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ferret.llm import periods

SF = "/root/testdata/sf0.001"


def brute_runs(w):
    """All maximal stretches with smallest period q and length >= max(24, 3 q), by the definition."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(24, 3 * q) and not any(
                    all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1) if j == i else j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if plant and doc_id is not None and h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def run(spark, monkeypatch, df):
    monkeypatch.setattr(periods, "table", lambda *_: df)
    return sorted([tuple(r) for r in periods.op11_periods(spark, "").collect()], key=str)


def made(rng):
    """A sequence with planted runs: powers of short, long and nested blocks, whole or cut, with faults."""
    w = []
    while len(w) < rng.randrange(1, 400):
        kind = rng.randrange(4)
        letters = "ab" if rng.random() < 0.5 else "abcdefghij"
        block = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 10, 11, 14, 15, 20, 21, 40]))]
        if kind == 0:
            w += [rng.choice("abcdefghij") for _ in range(rng.randrange(40))]
        elif kind == 1:
            w += (block * 40)[:rng.randrange(1, 5 * len(block) + 30)]
        elif kind == 2:  # nested: a block that is itself nearly periodic
            inner = block[:3] * rng.randrange(2, 9) + [rng.choice("abc")]
            w += inner * rng.randrange(2, 6) + inner[:rng.randrange(len(inner))]
        else:
            x = (block * 12)[:rng.randrange(24, 12 * len(block) + 25)]
            x[rng.randrange(len(x))] = "z"
            w += x
    return w


def test_bands_hold_every_lag():
    for (k, low, high), (_, after, _) in zip([b for _, b in zip(range(30), periods.bands(24, 3))], [b for _, b in zip(range(31), periods.bands(24, 3))][1:]):
        assert after == high + 1
        for q in range(low, high + 1):
            assert k <= max(24 - q, 2 * q) and 3 * q <= 2 * k
    with pytest.raises(ValueError):
        next(periods.bands(24, 2))


def test_random_sequences():
    rng = random.Random(5)
    seqs = [made(rng) for _ in range(400)] + [["a"] * 500, ["a"] * 23, ["a"] * 24, list("ab") * 12, list("ab") * 11 + ["a"], []]
    number = {}
    flat = np.array([number.setdefault(w, len(number)) for s in seqs for w in s], np.int64)
    got = periods.find_runs(flat, np.array([len(s) for s in seqs]))
    assert sum(map(len, got)) > 500
    for s, r in zip(seqs, got):
        assert sorted(r, key=lambda v: (v[0], v[2])) == brute_runs(s), s


def test_rows(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(made(rng)) for _ in range(60)] + [None, "", " \t\n\x0b\x0c\r ", "x", "a\x1fb\x85c " * 40, "é ü ö " * 30, "one two\n" * 30]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, runs int, collapsed string")
    assert run(spark, monkeypatch, df) == sorted([brute(i, t) for i, t in rows], key=str)
    assert run(spark, monkeypatch, df.limit(0)) == []


def test_long_text(spark):
    """A text of 10 MB of one word, and one of a long period, each one run."""
    rng = random.Random(7)
    block = " ".join(str(rng.randrange(1000)) for _ in range(90_000))
    df = spark.createDataFrame([(1, "word " * 2_000_000), (2, f"{block} " * 5)], "doc_id long, text string")
    got = {r.doc_id: r for r in periods.periodic_runs(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 2_000_000, 1)] and got[1].collapsed == "word"
    assert [tuple(x) for x in got[2].runs] == [(0, 450_000, 90_000)] and got[2].collapsed == block


def test_table(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 8000]
    got = {r[0]: r for r in run(spark, monkeypatch, df)}
    assert len(got) == len(rows) and sum(r[1] > 0 for r in got.values()) > len(rows) // 20
    for i, t in short:
        assert got[i] == brute(i, t)
