"""Cross-entropy difference of two matched n-gram models.

A target model (texts wanted) and a background model (all texts) have the same
vocabulary, order and smoothing.  The tokens are words (runs of letters, runs
of digits, any other character alone), all words of the corpus, and the models
count their 3-grams; no count reaches the driver.  Each order is interpolated
with the next lower one; below single words stands the spelling of the word
under a 4-gram model of characters, so that a word new to a model has a
probability, too.  A text's score is its loss under the target model minus that
under the background model, both over the text's length in characters.

Texts lie in blocks.  A block sends each of its distinct words, pairs and
3-grams once, with its counts, as sorted pages by bucket of their numbers.  The
pages of a bucket meet in one task, which adds the counts of all blocks and
sends the totals back by position; a block turns totals into probabilities and
sums them over its texts.  A word that fills a third of the corpus is thus one
entry of each block, and no text is shuffled.  Numbers have 18 bits more than it
takes to count the words, so at any size only some four grams in a million share
their number, and with it their counts, with another one.  Blocks are a table
bucketed by block.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferret.llm.common import BIN, DBL, INT, LONG, byte_batches, mix64, schema, shared_dir, shipped, stored, table, text_or_empty
from ferret.llm.windows import pack, unpack
from ferret.session import delete

# The model of spellings.  Symbols: 0 is a blank, the last one any character beyond the most frequent.
SYMBOLS = 48
ORDER = 4
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
# Words, distinct words, characters and texts after which a block is closed: bounds a worker's arrays.
BLOCK_TOKENS, BLOCK_WORDS, BLOCK_CHARS, BLOCK_TEXTS = 1_000_000, 200_000, 8_000_000, 100_000
# Words of the whole table per bucket of numbers: bounds one task's pages.
BUCKET_TOKENS = 1_000_000
# Mass of the lower order in each interpolation (in counts).
BACKOFF = 5.0
# Bits of a gram's number beyond those that count the words; two more, the lowest, tell its order.
SPARE_BITS = 18
ORDERS = np.uint64(3)

BLOCKS = T.StructType([*schema(block=LONG, n=LONG, t=LONG, words=BIN, data=BIN), *[
    T.StructField(c, T.ArrayType(k)) for c, k in (("ids", LONG), ("sizes", LONG), ("chars", LONG), ("wanted", T.BooleanType()))]])
PAGES = schema(block=LONG, bucket=INT, key=BIN, counts=BIN)
TOTALS = schema(block=LONG, bucket=INT, data=BIN)
SCORES = schema(doc_id=LONG, n_tokens=LONG, lt=DBL, lb=DBL)


@dataclass
class Vocabulary:
    chars: list[str]

    def __post_init__(self):
        self.size = len(self.chars) + 2
        self.code = np.full(0x250, self.size - 1, np.int64)
        self.rest = {}
        for k, c in enumerate(self.chars):
            if ord(c) < len(self.code):
                self.code[ord(c)] = k + 1
            else:
                self.rest[ord(c)] = k + 1
        for c in range(len(self.code)):
            if chr(c).isspace():
                self.code[c] = 0

    def symbols(self, text: str) -> np.ndarray:
        """The symbol of each character."""
        raw = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        x = self.code[np.minimum(raw, len(self.code) - 1)]
        for c, k in self.rest.items():
            x[raw == c] = k
        x[(raw >= len(self.code)) & ~np.isin(raw, list(self.rest))] = self.size - 1
        return x

    def grams(self, text: str) -> np.ndarray:
        """Numbers of the text's 4-grams, one per character; runs of blanks are one blank."""
        x = self.symbols(text)
        x = x[(x != 0) | np.concatenate([[True], x[:-1] != 0])[:len(x)]]
        padded = np.concatenate([np.zeros(ORDER - 1, np.int64), x])
        out = np.zeros(len(x), np.int64)
        for i in range(ORDER):
            out = out * self.size + padded[i:i + len(x)]
        return out


def vocabulary(docs: DataFrame, text_col: str, symbols: int = SYMBOLS) -> Vocabulary:
    """The most frequent characters of all texts (ties by code point)."""
    byte_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            some = np.bincount(np.frombuffer("".join(batch.column(0).to_pylist()).lower().encode("utf-32-le"), np.uint32))
            total[:len(some)] += some
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["c", "n"])

    top = (docs.select(text_or_empty(text_col)).mapInArrow(count, schema(c=INT, n=LONG)).groupBy("c").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "c").limit(symbols + 30).collect())
    return Vocabulary([chr(r.c) for r in top if not chr(r.c).isspace()][:symbols - 2])


def gram_counts(docs: DataFrame, vocab: Vocabulary, text_col: str, target_col: str) -> DataFrame:
    """(gram, n, t): uses in all texts and in target texts."""
    byte_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = vocab.size ** ORDER
        n, t = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in (n, t) if wanted else (n,):
                    np.add.at(x, vocab.grams(text), 1)
        for at in np.array_split(np.flatnonzero(n), 8):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(t[at])], names=["gram", "n", "t"])

    return (docs.select(text_or_empty(text_col).alias("text"), F.coalesce(F.col(target_col), F.lit(False)).alias("wanted"))
            .mapInArrow(count, schema(gram=INT, n=LONG, t=LONG)).groupBy("gram").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))


def log_probs(counts: np.ndarray, size: int) -> np.ndarray:
    """log p(last | first three) of every 4-gram: each order interpolated with the next lower one."""
    c = counts.reshape([size] * ORDER).astype(np.float64)
    p = np.full(size, 1 / size)
    for order in range(ORDER):
        joint = c.sum(axis=tuple(range(ORDER - 1 - order)))
        context = joint.sum(axis=-1, keepdims=True)
        p = (joint + BACKOFF * p) / (context + BACKOFF)
    return np.log(p).ravel().astype(np.float32)


@dataclass
class Spelling:
    vocab: Vocabulary
    target: np.ndarray
    background: np.ndarray

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log p of each word's characters and the blank behind it, under both models."""
        pad = " " * (ORDER - 1)
        x = self.vocab.symbols(pad + pad.join(words) + " ")
        n = np.array([len(word) + 1 for word in words])
        first = np.concatenate([[0], np.cumsum(n + ORDER - 2)[:-1]])
        out = np.zeros(len(x) - ORDER + 1, np.int64)
        for i in range(ORDER):
            out = out * self.vocab.size + x[i:i + len(out)]
        # the 4-grams that begin inside a word's own blanks or in the word; those of the next word's blanks are left out
        mine = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        return tuple(np.add.reduceat(p[out[mine]].astype(np.float64), at) for p in (self.target, self.background))


def _planes(x: np.ndarray) -> bytes:
    """Numbers from 0 on as zstandard over the byte planes of the smallest type that holds them."""
    x = x.astype(np.min_scalar_type(x.max(initial=0)))
    return bytes([x.itemsize]) + zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _unplanes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(f"u{raw[0]}").ravel()


def _packed(uses: np.ndarray, contexts: np.ndarray, head: np.ndarray) -> bytes:
    """Counts of a page's entries (2 rows), and counts as a context of those that can be one (``head``; 2 rows).

    Only the last word and pair of a text are no context, so contexts travel as what they differ by, nearly all zeros.
    """
    both, apart = _planes(uses.ravel()), (uses.compress(head, axis=1).astype(np.int64) - contexts).ravel()
    return len(both).to_bytes(4, "little") + both + _planes(apart << 1 ^ apart >> 63)


def _unpacked(raw: bytes, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    end = 4 + int.from_bytes(raw[:4], "little")
    uses, apart = _unplanes(raw[4:end]).reshape(2, -1).astype(np.int64), _unplanes(raw[end:]).reshape(2, -1).astype(np.int64)
    return uses, uses.compress(head[:uses.shape[1]], axis=1) - (apart >> 1 ^ -(apart & 1))


class Places(dict):
    """Word -> its place in order of first use; the empty word has place 0."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, words, docs, tokens, chars = TaskContext.get().partitionId() << 32, Places({"": 0}), [], 0, 0

    def flush() -> pa.RecordBatch:
        ids, places, lengths, wanted = zip(*docs)
        sizes = np.array([len(x) for x in places], np.int64)
        # no word holds white space, so a line break parts them
        row = {"block": block, "n": tokens, "t": int(sizes[np.array(wanted)].sum()),
               "words": zstandard.compress("\n".join(words).encode("utf-8")), "data": _planes(np.concatenate(places)),
               "ids": ids, "sizes": sizes, "chars": lengths, "wanted": wanted}
        kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.list_(pa.int64())] * 3 + [pa.list_(pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array([row[c]], k) for c, k in zip(BLOCKS.names, kinds)], names=BLOCKS.names)

    for batch in batches:
        for doc_id, text, length, yes in zip(*(batch.column(i) for i in range(4))):
            text = text.as_py().lower()
            if docs and (tokens >= BLOCK_TOKENS or len(words) >= BLOCK_WORDS or chars + len(text) > BLOCK_CHARS or len(docs) >= BLOCK_TEXTS):
                yield flush()
                block, words, docs, tokens, chars = block + 1, Places({"": 0}), [], 0, 0
            place = np.fromiter(map(words.__getitem__, WORD.findall(text)), np.int32)
            docs.append((doc_id.as_py(), place, length.as_py(), yes.as_py()))
            tokens, chars = tokens + len(place), chars + len(text)
    if docs:
        yield flush()


class Block:
    """The texts of a block and its distinct words, pairs and 3-grams.

    Word 0, the empty one, stands twice before each text.  ``first``, ``joint``,
    ``third`` and ``context`` give for every word of the texts the word itself,
    the pair and the 3-gram that end with it, and the pair before it.
    """

    def __init__(self, row: dict):
        self.words = zstandard.decompress(row["words"]).decode("utf-8").split("\n")
        self.first = _unplanes(row["data"]).astype(np.int64)
        self.ids, self.chars, self.wanted = row["ids"], row["chars"], np.array(row["wanted"], bool)
        self.sizes, size = np.array(row["sizes"], np.int64), len(self.words)
        starts = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        before = np.roll(self.first, 1)
        before[starts] = 0
        # the pair of two empty words has code 0, so it is pair 0
        self.pairs, joint = np.unique(np.append(before * size + self.first, 0), return_inverse=True)
        self.before, self.joint = before, joint[:-1]
        self.context = np.roll(self.joint, 1)
        self.context[starts] = 0
        self.grams, self.third = np.unique(self.context * size + self.first, return_inverse=True)

    def keys(self, bits: int) -> np.ndarray:
        """Numbers of the distinct words, pairs and 3-grams."""
        size = len(self.words)
        f = np.frombuffer(b"".join([xxhash.xxh3_64_digest(w.encode("utf-8")) for w in self.words]), np.uint64)
        one = mix64(f)
        two = mix64(one[self.pairs // size] + f[self.pairs % size])
        three = mix64(two[self.grams // size] + f[self.grams % size])
        return np.concatenate([x >> np.uint64(64 - bits) << np.uint64(2) | np.uint64(k) for k, x in enumerate((one, two, three), 1)])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Uses of every key in all and in target texts; uses of the words and pairs as a context in both."""
        sizes = [len(self.words), len(self.pairs), len(self.grams)]
        wanted = np.flatnonzero(np.repeat(self.wanted, self.sizes))

        def rows(*places: np.ndarray) -> np.ndarray:
            out = np.empty((2, sum(sizes[:len(places)])), np.int32)
            for x, n, end in zip(places, sizes, np.cumsum(sizes)):
                out[0, end - n:end] = np.bincount(x, minlength=n)
                out[1, end - n:end] = np.bincount(x[wanted], minlength=n)
            return out

        return rows(self.first, self.joint, self.third), rows(self.before, self.context)

    def losses(self, uses: np.ndarray, contexts: np.ndarray, spelt: tuple[np.ndarray, np.ndarray], words: tuple[int, int]) -> list[np.ndarray]:
        """Summed loss of every text under the target and the background model."""
        w, p = len(self.words), len(self.pairs)
        # the pair that ends a 3-gram, by any of its uses
        ends = np.zeros(len(self.grams), np.int64)
        ends[self.third] = self.joint
        head, last = np.divmod(self.pairs, w)
        pair, text = self.grams // w, np.repeat(np.arange(len(self.sizes)), self.sizes)
        out = []
        for k, lower, every in zip((1, 0), spelt, words):
            n, of = uses[k], contexts[k]
            one = _mixed(n[:w], np.int64(every), lower)
            two = _mixed(n[w:w + p], of[:w][head], one[last])
            three = _mixed(n[w + p:], of[w:][pair], two[ends])
            out.append(0.0 - np.bincount(text, three[self.third], len(self.sizes)))
        return out


def _mixed(n: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log of (n + BACKOFF * p) / (context + BACKOFF), p = exp(lower); a p too small for a double keeps its logarithm."""
    up, seen = lower + math.log(BACKOFF), n > 0
    up[seen] = np.log(n[seen] + BACKOFF * np.exp(lower[seen]))
    return up - np.log(context + BACKOFF)


def _pages(buckets: int, bits: int, asks: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            b = Block(row)
            key, (uses, contexts) = b.keys(bits), b.counts()
            order = np.argsort(key)
            key, uses = key[order], uses.take(order, axis=1) * (not asks)
            # words and pairs come first among the keys
            heads = order[order < contexts.shape[1]]
            contexts, can = contexts.take(heads, axis=1) * (not asks), key & ORDERS < ORDERS
            head = np.append(0, np.cumsum(can))
            # the bucket is the place of the key among all keys, so a page is a slice
            bucket = ((key >> np.uint64(bits - 30)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(first[1:], len(key))
            yield pa.RecordBatch.from_arrays([
                pa.array([~row["block"] if asks else row["block"]] * len(first), pa.int64()), pa.array(bucket[first]),
                pa.array([pack(key[i:j].view(np.int64)) for i, j in zip(first, ends)], pa.binary()),
                pa.array([_packed(uses[:, i:j], contexts[:, head[i]:head[j]], can[i:j]) for i, j in zip(first, ends)], pa.binary())], names=PAGES.names)


def _added(pages: pa.Table) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pages of one bucket -> (counts of each page, distinct keys, total uses, total uses as a context, the key of each entry)."""
    keys = [unpack(x.as_py()) for x in pages["key"]]
    counts = [_unpacked(x.as_py(), k & 3 < 3) for x, k in zip(pages["counts"], keys)]
    every = np.concatenate(keys)
    key, at = np.unique(every, return_inverse=True)
    # sums of counts below 2^53 are exact in a double
    sums = lambda at, rows: np.array([np.bincount(at, r, len(key)) for r in np.concatenate(rows, axis=1)]).astype(np.int64)
    head = at[every & 3 < 3]
    return counts, key, sums(at, [u for u, _ in counts]), sums(head, [c for _, c in counts]), at


def _totals(pages: pa.Table) -> pa.Table:
    """For every entry what other blocks count."""
    counts, key, uses, contexts, at = _added(pages)
    can = key[at] & 3 < 3
    head, out, i, j = at[can], [], 0, 0
    for u, c in counts:
        here, heads = at[i:i + u.shape[1]], head[j:j + c.shape[1]]
        out.append(_packed(uses.take(here, axis=1) - u, contexts.take(heads, axis=1) - c, can[i:i + len(here)]))
        i, j = i + len(here), j + len(heads)
    return pa.table([pages["block"], pages["bucket"], pa.array(out, pa.binary())], names=TOTALS.names)


def _asked(pages: pa.Table) -> pa.Table:
    """What the corpus counts, for the blocks that only ask."""
    out = _totals(pages)
    return out.filter(pc.less(out["block"], 0))


def _listed(pages: pa.Table) -> pa.Table:
    _, key, total, _, _ = _added(pages)
    mine = key & 3 == 3
    return pa.table([pa.array(key[mine]), pa.array(total[0][mine]), pa.array(total[1][mine])], names=["gram", "n", "t"])


@dataclass
class Model:
    """The corpus in blocks (the name of their table), with N words in all and T of target texts.

    Counts are made from the blocks when they are wanted; ``drop`` ends the model.
    """

    spelling: Spelling
    blocks: str
    spark: SparkSession
    N: int
    T: int

    def drop(self) -> None:
        _drop(self.spark, self.blocks)

    @property
    def buckets(self) -> int:
        return max(1, -(-self.N // BUCKET_TOKENS))

    @property
    def bits(self) -> int:
        return min(62, max(30, self.N.bit_length() + SPARE_BITS))

    def pages(self, blocks: str | None = None) -> DataFrame:
        """Pages of the corpus, or of other blocks that only ask for totals."""
        buckets, bits, asks = self.buckets, self.bits, blocks is not None
        return self.spark.table(blocks or self.blocks).mapInArrow(lambda it: _pages(buckets, bits, asks, it), PAGES)

    @property
    def tri(self) -> DataFrame:
        """(gram, n, t): every 3-gram of the corpus by its number, with its uses in all and in target texts."""
        return self.pages().groupBy("bucket").applyInArrow(_listed, schema(gram=LONG, n=LONG, t=LONG))


def in_blocks(docs: DataFrame, text_col: str, id_col: str, target: Column) -> str:
    """The texts in blocks: the name of a table whose files lie in the shared folder."""
    spark, text, name = docs.sparkSession, text_or_empty(text_col), f"ferret_lm_{uuid.uuid4().hex}"
    byte_batches(spark)
    length = F.length(F.regexp_replace(text, r"(?U)\s{2,}", " ")).cast("long")
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), length.alias("chars"), target.alias("wanted"))
            .mapInArrow(_blocks, BLOCKS))
    (rows.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name))
    return name


def _drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete(spark, f"{shared_dir(spark)}/{name}")


def fit(docs: DataFrame, target_col: str, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Both models from whole texts: the background from all rows, the target from those where ``target_col`` is true.

    Only the counts of the spelling model (at most SYMBOLS ** 4, of characters) reach the driver.
    """
    vocab = vocabulary(docs, text_col)
    got = gram_counts(docs, vocab, text_col, target_col).toPandas()
    counts = np.zeros((2, vocab.size ** ORDER), np.int64)
    counts[0, got["gram"]] = got["n"]
    counts[1, got["gram"]] = got["t"]
    spelling = Spelling(vocab, log_probs(counts[1], vocab.size), log_probs(counts[0], vocab.size))
    blocks = in_blocks(docs, text_col, id_col, F.coalesce(F.col(target_col), F.lit(False)))
    total = docs.sparkSession.table(blocks).agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    return Model(spelling, blocks, docs.sparkSession, total.n or 0, total.t or 0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", fitted: bool = False) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, ce_difference) of every row.

    ``n_tokens`` counts characters (a run of blanks is one); losses are nats per
    character; a lower difference is nearer to the target.  Null and empty texts
    and texts without a word have zeros; repeated rows and null ids are scored
    as any other; an empty table gives no rows.  Ids are cast to long.  Only the
    named columns are read, so no other column can clash.  A text is held whole
    by one task, at some 150 bytes a word.  ``fitted``: the rows are those the
    model was fitted on, so the model's own blocks are scored.
    """
    spark = docs.sparkSession
    blocks = model.blocks if fitted else in_blocks(docs, text_col, id_col, F.lit(False))
    byte_batches(spark)
    pages = model.pages() if fitted else model.pages().unionByName(model.pages(blocks))
    totals = pages.groupBy("bucket").applyInArrow(_totals if fitted else _asked, TOTALS)
    if not fitted:
        totals = totals.withColumn("block", F.bitwise_not("block"))
    spelling, words, bits = spark.sparkContext.broadcast(model.spelling), (model.T, model.N), model.bits

    def losses(rows: pa.Table, told: pa.Table) -> pa.Table:
        b = Block(rows.to_pylist()[0])
        order = np.argsort(b.keys(bits))
        uses, contexts = (x.astype(np.int64) * fitted for x in b.counts())
        can, parts, i = order < contexts.shape[1], [], 0
        for x in told.sort_by("bucket")["data"]:
            parts.append(_unpacked(x.as_py(), can[i:]))
            i += parts[-1][0].shape[1]
        for k in (0, 1):
            uses[k][order] += np.concatenate([u[k] for u, _ in parts])
            contexts[k][order[can]] += np.concatenate([c[k] for _, c in parts])
        lt, lb = b.losses(uses, contexts, spelling.value.of(b.words), words)
        return pa.table([pa.array(b.ids, pa.int64()), pa.array(b.chars, pa.int64()), pa.array(lt), pa.array(lb)], names=SCORES.names)

    out = spark.table(blocks).groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(losses, SCORES)
    loss = {c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")).otherwise(0.0) for c in ("lt", "lb")}
    out = stored(out.select("doc_id", "n_tokens", loss["lt"].alias("loss_target"), loss["lb"].alias("loss_background"),
                            (loss["lt"] - loss["lb"]).alias("ce_difference")), "lm-scores")
    if not fitted:
        _drop(spark, blocks)
    return out


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    wanted = stored(labels.where("doc_id is not null").groupBy("doc_id")
                    .agg((F.min("quality") == 1).alias("q"), (F.max("toxic") == 0).alias("c")).where("q and c")
                    .select("doc_id", F.lit(True).alias("wanted")), "lm-target")
    marked = docs.select("doc_id", "text").join(shipped(wanted), "doc_id", "left")
    model = fit(marked, "wanted")
    out = score(docs, model, fitted=True)
    model.drop()
    return out
