"""Removal of windows that an earlier document holds, against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ferret.llm import windows

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows, size=13):
    """(doc_id, n_words, spans with longest, kept) by the definition."""
    least = []
    length = size
    while True:
        low = {}
        for d, t in rows:
            w = words(t)
            for i in range(len(w) - length + 1 if d is not None else 0):
                g = tuple(w[i:i + length])
                low[g] = min(low.get(g, d), d)
        least.append((length, low))
        if not low or length > 4000:
            break
        length *= 2
    out = []
    for d, t in rows:
        w = words(t)
        top = [0] * len(w)
        gone = [False] * len(w)
        for length, low in least:
            for i in range(len(w) - length + 1 if d is not None else 0):
                if low[tuple(w[i:i + length])] < d:
                    top[i] = length
                    if length == size:
                        gone[i:i + size] = [True] * size
        spans = []
        for i, x in enumerate(gone):
            if x and (i == 0 or not gone[i - 1]):
                j = i
                while j < len(w) and gone[j]:
                    j += 1
                spans.append((i, j, max(top[i:j])))
        out.append((d, len(w), tuple(spans), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def found(df, **how):
    return sorted(((r.doc_id, r.n_words, tuple(tuple(s) for s in r.spans), r.kept) for r in windows.remove_earlier(df, **how).collect()), key=str)


def made(rng, n=60):
    vocab = [f"w{i}" for i in range(40)] + ["é", "x\x1fy", "of", "the"]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages = [text(k) for k in (13, 14, 27, 60, 200, 900)]
    docs = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            w += text(rng.randrange(30)) + (p if rng.random() < 0.5 else p[a:a + rng.randrange(5, 100)])
        docs.append(rng.choice(" \n\t").join(w))
    return docs


def test_pages_keep_their_numbers():
    rng = np.random.default_rng(1)
    for x in (rng.integers(-2**63, 2**63 - 1, 1000), np.sort(rng.integers(0, 2**48, 1000)), np.array([], np.int64), np.array([-1, 2**62])):
        assert (windows.unpack(windows.pack(x)) == x).all()


def test_blocks_keep_every_word(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr(windows, "TaskContext", Task)
    texts = made(random.Random(5), 40) + ["", " \x0b ", " a\x0c\r\nb\x1fé\x85 ", "x", ""]
    ids = [k if k % 9 else None for k in range(len(texts))]
    rows = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    for most_words, most_bytes in ((10**6, 10**6), (10**6, 3000), (30, 10**6), (1, 1)):
        monkeypatch.setattr(windows, "BLOCK_WORDS", most_words)
        monkeypatch.setattr(windows, "BLOCK_BYTES", most_bytes)
        got, blocks = [], {}
        for r in pa.Table.from_batches(windows._blocks(iter([rows.slice(0, 7), rows.slice(7, 0), rows.slice(7)]))).to_pylist():
            blocks.setdefault(r["block"], []).append(r)
        for block, docs in blocks.items():
            raw = next(r["data"] for r in docs if r["ord"] == -1)
            vocab = raw.decode().split("\n") if raw else []
            docs = sorted((r for r in docs if r["ord"] >= 0), key=lambda r: r["ord"])
            last = set(words(texts[len(got) + len(docs) - 1]))
            # a block is closed by the document that brings it to its words, or before it goes over its bytes
            assert len(set(vocab)) == len(vocab) < most_words + max(1, len(last))
            sizes = [len(t.encode()) for t in texts[len(got):len(got) + len(docs)] if t]
            assert len(sizes) <= 1 or sum(sizes) <= most_bytes
            for r in docs:
                got.append((r["doc_id"], r["n"], [vocab[i] for i in np.frombuffer(r["data"], np.int32)]))
        assert got == [(i, len(words(t)), words(t)) for i, t in zip(ids, texts)]
        assert len(blocks) > (0 if (most_words, most_bytes) == (10**6, 10**6) else 2)


def test_texts_are_not_read_at_every_length(spark, monkeypatch):
    """However long the repeats are, the table of whole blocks is read for its size, the first length, the cut and the end."""
    body = [str(i % 701) + "x" * (i % 3) for i in range(400)]
    rows = [(k, " ".join([f"only {k}", *body, f"end {k}"])) for k in range(3)]
    read, table = [], SparkSession.table
    monkeypatch.setattr(SparkSession, "table", lambda self, name: read.append(name) or table(self, name))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert sum(not name.endswith("_cut") for name in read) <= 4


def test_made_documents(spark, monkeypatch):
    rng = random.Random(3)
    texts = made(rng) + [None, "", " \x0b ", "a " * 50, "a " * 12, "a " * 13]
    rows = [(100 - k, t) for k, t in enumerate(texts)] + [(40, texts[3]), (40, texts[60]), (None, texts[5]), (None, None)]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, block int, kept string")
    want = brute(rows)
    assert sum(bool(r[2]) for r in want) > 20 and max(s[2] for r in want for s in r[2]) >= 416
    assert found(df.repartition(3)) == want
    # blocks and buckets of another size give the same rows
    monkeypatch.setattr(windows, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(windows, "BUCKET_WINDOWS", 300)
    assert found(df) == want
    assert found(df, size=2) == brute(rows, 2)
    assert found(df.limit(0)) == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ferret_windows")]


def test_long_text_and_common_passage(spark):
    """A long document repeated in part, and a passage that every document holds."""
    rng = random.Random(4)
    body = [str(rng.randrange(50_000)) for _ in range(300_000)]
    rows = [(1, " ".join(body)), (2, " ".join(["new", *body[1000:200_000], "end"]))] + [(k, " ".join(body[:40]) + f" tail {k}") for k in range(3, 400)]
    got = {r[0]: r for r in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1][2] == () and got[2][2] == ((1, 199_001, 13 * 2**13),) and got[2][3] == "new end"
    # the word "tail" is new in document 3 alone
    assert got[3][2] == ((0, 40, 26),) and got[3][3] == "tail 3"
    assert all(got[k][2] == ((0, 41, 26),) and got[k][3] == str(k) for k in range(4, 400))


def test_table(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(windows, "table", lambda *_: docs)
    got = sorted(tuple(r) for r in windows.op12_windows(spark, "").collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == sorted(con.sql(windows.OP12_SQL).fetchall())
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got == sorted((d, n, sum(j - i for i, j, _ in s), hashlib.sha256(k.encode()).hexdigest()) for d, n, s, k in want)
