"""Encoding and decoding equal the tokenizers library on every text."""

import hashlib

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ferret.llm import bpe

SF = "/root/testdata/sf0.001"
ODD = ["", None, " \n\t ", "a", "Don't  STOP!! 123", "x<|endoftext|>Y <|startoftext|>", "日本語 テスト ñandú İΑΣ.", "é\x00\x1c a",
       "don't'll''s <|endoftext", "w" * 5000, "The the THE " * 3000, "a"]


def test_odd_texts(spark):
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    df = spark.createDataFrame([(i if i != 3 else None, t, "x", 1) for i, t in enumerate(ODD)],
                               "doc_id long, text string, ids string, block int")
    got = bpe.encode(df).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(ODD):
        want = tok.encode(t or "", add_special_tokens=False).ids
        r = by[i if i != 3 else None]
        assert list(r.ids) == want
        assert r.decoded == tok.decode(want, skip_special_tokens=False)


def test_whole_table_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 500)
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    got = {r.doc_id: r for r in bpe.op3_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = tok.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decode_general_and_empty(spark):
    path = bpe.default_tokenizer()
    tok = Tokenizer.from_file(path)
    df = spark.createDataFrame([(1, [320, 49407, 5]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, path).collect()}
    assert got == {1: tok.decode([320, 49407, 5], skip_special_tokens=False), 2: "", 3: ""}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty).count() == 0
    assert bpe.encode(empty.withColumn("n", F.lit(1))).columns == ["doc_id", "ids", "decoded"]
