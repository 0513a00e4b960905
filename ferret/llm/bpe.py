"""BPE encoding and decoding through a table of distinct words.

Documents are split into words once, in blocks.  A block writes its distinct
words as sorted dictionary pages, one per hash bucket of words, and each
document as the positions of its words in that dictionary.  The pages of a
bucket meet in one task, where every distinct word of the corpus is encoded
once; its ids go back to the blocks by position.  Ids become text through a
join with the table of pieces.  A word has at most one place per block, so even
a word that fills a third of the corpus is a tiny share of any shuffle.  The
blocks are a table bucketed by block, so the documents are never shuffled.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ferret.llm.common import BIN, INT, LONG, STR, byte_batches, schema, table, text_or_empty

# Distinct words after which a block is closed: bounds a worker's dictionary.
BLOCK_WORDS = 200_000
# Characters after which a block is closed: bounds the texts of one group.
BLOCK_CHARS = 10_000_000
# Hash buckets of words: one task holds the distinct words of one bucket.
BUCKETS = 1024

# The word pattern and the space class of the tokenizer file.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Texts within these characters are split by WORD on the lower-cased text;
# any other text goes through the library's own normalizer and splitter.
BEYOND = regex.compile(r"[^\x00-ɏ]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> list[str]:
    """Printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Splitter:
    """Text -> words, as the tokenizer cuts it before any merge."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder()
        self.special = {t.content for t in added.values()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.byte = {c: b for b, c in enumerate(byte_chars())}

    def part(self, text: str) -> list[str]:
        if BEYOND.search(text) is None:
            return WORD.findall(text.lower())
        pieces = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
        return [bytes(self.byte[c] for c in p).decode("utf-8") for p, _ in pieces]

    def __call__(self, text: str) -> list[str]:
        if "<|" not in text:
            return self.part(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self.part(part)
        return out


def _blocks(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = Splitter(path)
    block, words, docs, chars = TaskContext.get().partitionId() << 32, {}, [], 0
    names = ["block", "doc_id", "bucket", "data"]

    def flush():
        order = sorted(words, key=lambda w: (zlib.crc32(w.encode("utf-8")) % BUCKETS, w))
        place = np.empty(len(words), np.int32)
        place[[words[w] for w in order]] = np.arange(len(words))
        bucket = np.array([zlib.crc32(w.encode("utf-8")) % BUCKETS for w in order], np.int32)
        used, first = np.unique(bucket, return_index=True)
        ends = np.append(first[1:], len(order))
        # no word holds white space, so a line break parts them
        pages = [zstandard.compress("\n".join(order[i:j]).encode("utf-8")) for i, j in zip(first, ends)]
        for i in range(0, len(docs), 500):
            some = docs[i:i + 500]
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * len(some), pa.int64()), pa.array([d for d, _ in some], pa.int64()),
                pa.nulls(len(some), pa.int32()), pa.array([place[x].tobytes() for _, x in some], pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(pages), pa.int64()), pa.nulls(len(pages), pa.int64()),
                                          pa.array(used, pa.int32()), pa.array(pages, pa.binary())], names=names)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if docs and (len(words) >= BLOCK_WORDS or chars + len(text) > BLOCK_CHARS):
                yield from flush()
                block, words, docs, chars = block + 1, {}, [], 0
            chars += len(text)
            docs.append((doc_id, np.array([words.setdefault(w, len(words)) for w in split(text)], np.int32)))
    if docs:
        yield from flush()


def split_words(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (block, doc_id, data = word positions) and of dictionary pages (block, bucket, data = words)."""
    byte_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        lambda it: _blocks(path, it), schema(block=LONG, doc_id=LONG, bucket=INT, data=BIN))


def _encode_pages(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tok = Tokenizer.from_file(path)
    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    chars = byte_chars()
    now, known = None, {}
    for batch in batches:
        pages = []
        for bucket, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if bucket != now:
                now, known = bucket, {}
            flat, counts = [], []
            for w in zstandard.decompress(page).decode("utf-8").split("\n"):
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = [special[w]] if w in special else [
                        t.id for t in tok.model.tokenize("".join([chars[b] for b in w.encode("utf-8")]))]
                flat += ids
                counts.append(len(ids))
            pages.append(zstandard.compress(np.array([len(counts), *counts, *flat], np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pages, pa.binary())],
                                         names=["block", "bucket", "ids"])


def encode_pages(pages: DataFrame, path: str) -> DataFrame:
    """(block, bucket, data) -> (block, bucket, ids): each distinct word of a bucket is encoded once."""
    return (pages.select("block", "bucket", "data").repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(lambda it: _encode_pages(path, it), schema(block=LONG, bucket=INT, ids=BIN)))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the vocabulary, added tokens included; as many rows as the vocabulary file has."""
    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(pd.DataFrame({"id": list(vocab.values()), "piece": list(vocab)}),
                                 schema(id=INT, piece=STR))


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids) -> (key, decoded) by a join of every id with its piece.

    The file names no decoder, so pieces are joined by one space and special
    tokens stay.  ``key`` must be unique.  No ids or null ids give the empty
    text; an id outside the vocabulary gives nothing.  The table of pieces is
    bounded by the vocabulary file, so it is broadcast.
    """
    spark = encoded.sparkSession
    flat = encoded.select(F.col(key).alias("k"), F.posexplode_outer(F.col(ids)).alias("pos", "id"))
    return (flat.join(F.broadcast(pieces(spark, path)), "id", "left").groupBy("k")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]),
                              " ").alias("decoded"))
            .select(F.col("k").alias(key), "decoded"))


def _assemble(piece: np.ndarray, pages: pa.Table, docs: pa.Table) -> pa.Table:
    """Ids and text of the documents of one block; ``piece`` is the table of pieces by id."""
    parts = [np.frombuffer(zstandard.decompress(x.as_py()), np.int32) for x in pages.sort_by("bucket")["ids"]]
    counts = np.concatenate([np.empty(0, np.int64), *[p[1:1 + p[0]] for p in parts]]).astype(np.int64)
    flat = np.concatenate([np.empty(0, np.int32), *[p[1 + p[0]:] for p in parts]])
    starts = np.cumsum(counts) - counts
    sizes, values, decoded = [0], [], []
    for raw in docs["data"]:
        idx = np.frombuffer(raw.as_buffer(), np.int32)
        n = counts[idx]
        ids = flat[np.repeat(starts[idx] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        sizes.append(len(ids))
        values.append(ids)
        decoded.append(" ".join(piece[ids]))
    # offsets of a list column are 32 bits: a block holds far fewer ids
    ids = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *values])))
    return pa.table({"doc_id": docs["doc_id"], "ids": ids, "decoded": pa.array(decoded, pa.string())})


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: one row (doc_id, ids, decoded) per input row.

    Equal to the tokenizers library's ``encode(text, add_special_tokens=False)``
    and ``decode(ids, skip_special_tokens=False)``.  Null and empty texts give
    no ids and an empty text; repeated rows and null ids are kept as they are;
    only ``id_col`` and ``text_col`` are read, so other columns cannot clash.
    The table of pieces is joined map-side: the vocabulary file bounds it.
    """
    spark, path = docs.sparkSession, path or default_tokenizer()
    name = f"ferret_bpe_blocks_{uuid.uuid4().hex}"
    (split_words(docs, path, id_col, text_col).write.format("parquet").option("compression", "zstd")
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name))
    back = encode_pages(spark.table(name).where("bucket is not null"), path)
    texts = spark.table(name).where("bucket is null").select(F.col("block").alias("of"), "doc_id", "data")
    rows = pieces(spark, path).collect()
    by_id = np.empty(max(r.id for r in rows) + 1, object)
    by_id[[r.id for r in rows]] = [r.piece for r in rows]
    piece = spark.sparkContext.broadcast(by_id)
    return (back.groupBy("block").cogroup(texts.groupBy("of"))
            .applyInArrow(lambda w, d: _assemble(piece.value, w, d), schema(doc_id=LONG, ids=T.ArrayType(INT), decoded=STR)))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
