"""Removal of word windows that an earlier document holds, by level-wise doubling.

Windows are tested for repeats at one length after another.  The first length is
just over half the wanted one and only sorts out: a window of the wanted size is
looked at only if both halves repeat.  From then on a window of twice the length
is looked at only where the two windows that make it up both repeat, until no
candidate survives; the wanted size decides what goes, the longer ones tell how
long the repeat is.

Documents lie in blocks as positions in the block's dictionary of words.  At
each length a block sends every distinct candidate window once, with the least
document id that holds it in the block, as sorted pages by bucket of
fingerprints.  A bucket tells each block which of its windows other blocks hold
and which stand in a smaller document; a passage that fills a third of the
corpus is thus one entry of each block.  Buckets are as many as the windows ask
for.  Blocks are a table bucketed by block, so texts are never shuffled.

After the first length a block is cut down to the stretches of words that some
candidate covers, with the fingerprints of their words; all further lengths read
these cuts alone, which are a bucketed table too.

Windows are compared by fingerprints of 96 bits over fingerprints of their
words (42 bits at the first length, where a chance meeting only costs work).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferret.llm.common import BIN, INT, LONG, STR, byte_batches, schema, shared_dir, stored, table, text_or_empty
from ferret.session import delete

SIZE = 13
# Distinct words and bytes after which a block is closed: bounds a worker's arrays.
BLOCK_WORDS = 300_000
BLOCK_BYTES = 8_000_000
# Windows of the whole table per bucket of fingerprints: bounds one task's pages.
BUCKET_WINDOWS = 1_000_000
C1 = np.uint64(0x9E3779B97F4A7C15)
HALF, SHIFT = np.uint64(32), np.uint64(29)
# Keys of the first length have 42 bits, so that a key and a place sort as one integer.
PLACE_BITS = 22
PLACE, PLACES = np.uint64(PLACE_BITS), np.uint64((1 << PLACE_BITS) - 1)

SPANS = T.ArrayType(schema(start=LONG, end=LONG, longest=LONG))
BLOCKS = schema(block=LONG, ord=INT, doc_id=LONG, n=LONG, data=BIN)
FLAGS = schema(block=LONG, bucket=INT, data=BIN)
# What a block says after a length: its cut (bucket -2, after the first length alone), its candidates of the next length
# (bucket -1; there, "earlier" is what the cut covers after the first length), and its pages of the next length.
CUTS = schema(block=LONG, ids=BIN, sizes=BIN, place=BIN, prints=BIN)
STEPS = schema(block=LONG, bucket=INT, key=BIN, check=BIN, low=BIN, n=LONG, candidates=BIN, earlier=BIN, **{f.name: f.dataType for f in CUTS[1:]})


def lengths(size: int) -> Iterator[int]:
    """The lengths tested: just over half of ``size``, which only sorts out, then ``size`` and its doubles without end."""
    yield size // 2 + 1
    while True:
        yield size
        size *= 2


def pack(x: np.ndarray) -> bytes:
    """Integers as zstandard over the byte planes of their differences."""
    step = np.diff(x.astype(np.int64, copy=False), prepend=np.int64(0))
    return zstandard.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def _bits(x: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(x).tobytes(), 1)


def _unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(raw), np.uint8), count=n).astype(bool)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, held, size = TaskContext.get().partitionId() << 32, [], 0

    def flush():
        nonlocal block
        docs = pa.concat_arrays([x.column(0) for x in held]), pa.concat_arrays([x.column(1) for x in held])
        while len(docs[0]):
            split = pc.ascii_split_whitespace(docs[1])
            words = split.flatten()
            some = pc.not_equal(words, "")
            ends = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy()]
            words = words.filter(some).dictionary_encode()
            place = words.indices.to_numpy()
            # words are numbered as they appear: so many are known at the end of each document
            known = np.concatenate([[0], np.maximum.accumulate(place) + 1])[ends[1:]]
            taken = min(int((known < BLOCK_WORDS).sum()) + 1, len(known))
            for i in range(0, taken, 500):
                j = min(i + 500, taken)
                data = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(((ends[i:j + 1] - ends[i]) * 4).astype(np.int32)),
                                                                  pa.py_buffer(place[ends[i]:ends[j]])])
                yield pa.RecordBatch.from_arrays([pa.array([block] * (j - i), pa.int64()), pa.array(range(i, j), pa.int32()), docs[0][i:j],
                                                  pa.array(np.diff(ends[i:j + 1]), pa.int64()), data], names=BLOCKS.names)
            # no word holds a line break
            raw = pc.binary_join(pa.ListArray.from_arrays([0, int(known[taken - 1])], words.dictionary), "\n").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.nulls(1, pa.int64()),
                                              pa.array([0], pa.int64()), raw], names=BLOCKS.names)
            block, docs = block + 1, (docs[0][taken:], docs[1][taken:])

    for batch in batches:
        start = 0
        for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
            if size and size + n > BLOCK_BYTES:
                held.append(batch.slice(start, i - start))
                yield from flush()
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if held:
        yield from flush()


def _groups(key: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (key, check), the keys in order and the first place of each distinct pair; equal pairs in any order."""
    if check is None and len(key) <= 1 << PLACE_BITS:
        both = key << PLACE
        both |= np.arange(len(key), dtype=np.uint64)
        both.sort()
        order, k = (both & PLACES).view(np.int64), both >> PLACE
    else:
        order = np.argsort(key)
        k = key[order]
    new = k[1:] != k[:-1]
    if check is not None and (check[order][1:] != check[order][:-1])[~new].any():
        # one key, two checks: all but never
        order = np.lexsort((check, key))
        new |= check[order][1:] != check[order][:-1]
    return order, k, np.flatnonzero(np.concatenate([[True], new])[:len(key)])


def _roll(h: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of words -> those of the windows that start at each, in place; the last ``length`` - 1 are void."""
    width = 1
    while width < length:
        step = min(width, length - width)
        both = h[:-step] * C1
        both += h[step:]
        both ^= both >> SHIFT
        h[:-step] = both
        width += step
    return h


def _covered(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` words the windows at the given places cover."""
    edge = np.zeros(n + 1, np.int32)
    edge[at] += 1
    edge[at + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _halves(b: Block | Cut, repeated: np.ndarray, step: int) -> np.ndarray:
    """First words of the windows that two repeated ones, ``step`` words apart, make up."""
    at = np.flatnonzero(repeated)
    at = at[at + step < b.n]
    return at[repeated[at + step] & (b.doc[at] == b.doc[at + step])]


class Block:
    """The documents of one block; word positions count through the whole block."""

    def __init__(self, docs: pa.Table):
        docs = docs.sort_by("ord")
        raw = docs["data"][0].as_py()
        self.words = raw.split(b"\n") if raw else []
        self.doc_id = docs["doc_id"].slice(1)
        self.id = self.doc_id.fill_null(0).to_numpy()
        self.sizes = docs["n"].to_numpy()[1:]
        self.ends = np.cumsum(self.sizes)
        self.n = int(self.sizes.sum())
        rows = docs["data"].combine_chunks()[1:]
        self.place = np.concatenate([np.empty(0, np.int32), *[np.frombuffer(x.as_buffer(), np.int32) for x in rows]])
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.known = self.doc_id.is_valid().to_numpy()

    def keys(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``length``, and their keys."""
        prints = np.frombuffer(b"".join([xxhash.xxh3_64_digest(x) for x in self.words]), np.uint64)
        # a window ends in its own document, which has an id
        free = np.repeat(np.where(self.known, self.ends - length, -1), self.sizes)
        at = np.flatnonzero(np.arange(self.n) <= free)
        return at, _roll(prints[self.place], length)[at] >> PLACE

    def repeated(self, length: int, told: pa.Table) -> np.ndarray:
        """Where the windows start that repeat, by the answers of the buckets."""
        at, key = self.keys(length)
        order, _, first = _groups(key, None)
        many = np.diff(np.append(first, len(key)))
        flags = _flags(told) & 1 > 0
        # those that two documents of this block hold
        more = many > 1
        ids = self.id[self.doc[at[order[np.repeat(more, many)]]]]
        if len(ids):
            starts = np.cumsum(many[more]) - many[more]
            flags[more] |= np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts)
        out = np.zeros(self.n, bool)
        out[at[order[np.repeat(flags, many)]]] = True
        return out

    def cut(self, at: np.ndarray, length: int) -> tuple[np.ndarray, dict, np.ndarray]:
        """What the windows at the given places cover: (words covered, the cut's columns, the windows' places in the cut)."""
        here = _covered(self.n, at, length)
        where = np.flatnonzero(here)
        doc = self.doc[where]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(where) > 1) | (np.diff(doc) > 0)]))
        used = np.zeros(len(self.words), bool)
        used[self.place[where]] = True
        prints = b"".join([xxhash.xxh3_128_digest(self.words[i]) for i in np.flatnonzero(used).tolist()])
        place = (np.cumsum(used) - 1).astype(np.int32)[self.place[where]]
        return here, {"ids": pack(self.id[doc[first]]), "sizes": pack(np.diff(np.append(first, len(where)))), "place": place.tobytes(),
                      "prints": prints}, (np.cumsum(here) - 1)[at]


class Cut:
    """The stretches of a block that candidates cover; word positions count through all of them."""

    def __init__(self, cut: dict):
        self.id, sizes = unpack(cut["ids"]), unpack(cut["sizes"])
        self.place = np.frombuffer(cut["place"], np.int32)
        self.prints = np.frombuffer(cut["prints"], np.uint64).reshape(-1, 2)
        self.n = len(self.place)
        # stretches take the part of documents: no window goes over an end
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def entries(self, length: int, at: np.ndarray):
        """Distinct windows at the given places: (places in order, entry of each, key, check, least and largest document id)."""
        # of the words that the windows cover, and of no others
        here = _covered(self.n, at, length)
        where = (np.cumsum(here) - 1)[at]
        place = self.place[here]
        key, check = (_roll(self.prints[:, k][place], length)[where] for k in range(2))
        check >>= HALF
        order, key, first = _groups(key, check)
        check, at = check[order], at[order]
        entry = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        ids = self.id[self.doc[at]]
        low, high = (f.reduceat(ids, first) if len(first) else ids for f in (np.minimum, np.maximum))
        return at, entry, key[first], check[first], low, high

    def pages(self, block: int, at: np.ndarray, length: int, buckets: int) -> list[dict]:
        """The distinct windows at the given places as sorted pages, one per bucket."""
        _, _, key, check, low, _ = self.entries(length, at)
        return [{"block": block, "bucket": k, "key": pack(key[i:j].view(np.int64)), "check": zstandard.compress(check[i:j].astype(np.uint32).tobytes(), 1),
                 "low": pack(low[i:j])} for k, i, j in _slices(key >> HALF, buckets)]


def _slices(top: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted keys by their first 32 bits: the bucket is the place of the key among all keys, so a page is a slice."""
    bucket = (top * np.uint64(buckets) >> HALF).astype(np.int32)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[first].tolist(), first.tolist(), np.append(first[1:], len(top)).tolist()))


def _steps(rows: list[dict]) -> pa.Table:
    types = {"block": pa.int64(), "bucket": pa.int32(), "n": pa.int64()}
    return pa.table([pa.array([r.get(c) for r in rows], types.get(c, pa.binary())) for c in STEPS.names], names=STEPS.names)


def _flags(told: pa.Table) -> np.ndarray:
    """The answers of the buckets, in their order, for all entries of a block."""
    told = told.filter(pc.greater_equal(told["bucket"], 0)).sort_by("bucket")
    return np.concatenate([np.empty(0, np.uint8), *[np.frombuffer(zstandard.decompress(x.as_py()), np.uint8) for x in told["data"]]])


def _meet(pages: pa.Table) -> pa.Table:
    """The pages of one bucket -> for every entry: 1 another block has it, 2 a smaller document of another block has it."""
    exact = pages["low"].null_count == 0
    keys = [unpack(x.as_py()) for x in pages["key"]]
    sizes = np.array([len(x) for x in keys])
    key = np.concatenate(keys).view(np.uint64)
    if exact:
        check = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), np.uint32) for x in pages["check"]])
        low = np.concatenate([unpack(x.as_py()) for x in pages["low"]])
    order, _, first = _groups(key, check if exact else None)
    many = np.diff(np.append(first, len(key)))
    flags = np.empty(len(key), np.uint8)
    flags[order] = np.repeat(many > 1, many)
    if exact:
        least = np.empty(len(key), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(low[order], first), many)
        flags += (least < low).astype(np.uint8) * 2
    parts = np.split(flags, np.cumsum(sizes)[:-1])
    return pa.table([pages["block"], pages["bucket"], pa.array([zstandard.compress(x.tobytes(), 1) for x in parts], pa.binary())], names=FLAGS.names)


def _first(length: int, buckets: int):
    """Documents of a block -> their pages of the first length."""
    def step(docs: pa.Table) -> pa.Table:
        key = np.sort(Block(docs).keys(length)[1])
        key = key[np.diff(key, prepend=~key[:1]) != 0]
        block = docs["block"][0].as_py()
        return _steps([{"block": block, "bucket": k, "key": pack(key[i:j].view(np.int64))}
                       for k, i, j in _slices(key >> np.uint64(32 - PLACE_BITS), buckets)])

    return step


def _cut(length: int, after: int, buckets: int):
    """Documents of a block and the answers for the first length -> the block's cut, and its pages of the length ``after``."""
    def step(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not len(told):
            return _steps([])
        b, block = Block(docs), docs["block"][0].as_py()
        at = _halves(b, b.repeated(length, told), after - length)
        if not len(at):
            return _steps([])
        here, cut, at = b.cut(at, after)
        c = Cut(cut)
        state = {"block": block, "bucket": -1, "n": len(at), "candidates": _places(at, c.n), "earlier": _bits(here)}
        return _steps([{"block": block, "bucket": -2, **cut}, state, *c.pages(block, at, after, buckets)])

    return step


def _next(length: int, after: int, buckets: int):
    """The cut of a block, its candidates and the answers for ``length`` -> its windows that an earlier document holds,
    and its pages of the length ``after``."""
    def step(cut: pa.Table, told: pa.Table) -> pa.Table:
        mine = told.filter(pc.equal(told["bucket"], -1))
        if not len(mine):
            return _steps([])
        c, block = Cut(cut.to_pylist()[0]), cut["block"][0].as_py()
        at, entry, _, _, low, high = c.entries(length, np.flatnonzero(_unbits(mine["data"][0].as_py(), c.n)))
        flags = _flags(told)
        new, earlier = np.zeros(c.n, bool), np.zeros(c.n, bool)
        new[at] = ((flags & 1 > 0) | (low < high))[entry]
        earlier[at] = (flags & 2 > 0)[entry] | (c.id[c.doc[at]] > low[entry])
        if not new.any():
            return _steps([])
        at = _halves(c, new, after - length)
        state = {"block": block, "bucket": -1, "n": len(at), "candidates": _places(at, c.n), "earlier": _bits(earlier)}
        return _steps([state, *c.pages(block, at, after, buckets)])

    return step


def _places(at: np.ndarray, n: int) -> bytes:
    out = np.zeros(n, bool)
    out[at] = True
    return _bits(out)


def _remove(size: int, docs: pa.Table, state: pa.Table) -> pa.Table:
    b = Block(docs)
    longest, edge = np.zeros(b.n, np.int64), np.zeros(b.n + 1, np.int64)
    told = sorted(zip(state["bucket"].to_pylist(), state["data"].to_pylist()))
    # first, under 0, the words that the cut covers
    where = np.flatnonzero(_unbits(told[0][1], b.n)) if told else None
    for length, raw in told[1:]:
        at = where[_unbits(raw, len(where))]
        longest[at] = length
        if length == size:
            edge[at] += 1
            edge[at + size] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    begins = b.ends - b.sizes
    # stretches that go, each in one document
    first, last = (np.zeros(b.n, bool) for _ in range(2))
    first[begins[b.sizes > 0]], last[b.ends[b.sizes > 0] - 1] = True, True
    first[1:] |= ~gone[:-1]
    last[:-1] |= ~gone[1:]
    start, end = np.flatnonzero(gone & first), np.flatnonzero(gone & last) + 1
    doc = b.doc[start]
    most = np.maximum.reduceat(np.append(longest, 0), np.stack([start, end], 1).ravel())[::2] if len(start) else start
    rows = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    spans = pa.ListArray.from_arrays(rows(np.bincount(doc, minlength=len(b.sizes))), pa.StructArray.from_arrays(
        [pa.array(start - begins[doc], pa.int64()), pa.array(end - begins[doc], pa.int64()), pa.array(most, pa.int64())], ["start", "end", "longest"]))
    words = pa.array(b.words, pa.binary()).cast(pa.string()).take(pa.array(b.place[~gone]))
    kept = pc.binary_join(pa.ListArray.from_arrays(rows(np.bincount(b.doc[~gone], minlength=len(b.sizes))), words), " ")
    return pa.table([b.doc_id.combine_chunks(), pa.array(b.sizes, pa.int64()), spans, kept], names=["doc_id", "n_words", "spans", "kept"])


def remove_earlier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, spans, kept) of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes if a window of ``size``
    words that covers it also starts in a document of a smaller id; windows are
    judged on the input.  ``spans`` are the maximal stretches (start, end) that
    go, ``longest`` the greatest of the lengths size, 2 size, 4 size ... of which
    a window that starts there stands whole in one earlier document; ``kept`` are
    the words left, joined by one space.

    Null, empty and short texts lose nothing; rows of one id are one document to
    each other; a row without an id takes no part and stays whole; an empty
    table gives no rows.  Ids are cast to long.  Only the two named columns are
    read, so no other column can clash.  A text is held whole by one task, at
    some 100 bytes a word.
    """
    spark = docs.sparkSession
    byte_batches(spark)
    name = f"ferret_windows_{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(_blocks, BLOCKS)
    _bucketed(rows, name)
    try:
        return _remove_earlier(spark, name, size)
    finally:
        # the entries of the catalogue only: the files lie in the shared folder
        for t in (name, f"{name}_cut"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def _bucketed(rows: DataFrame, name: str) -> None:
    """A table by block, so that groups of its blocks need no shuffle."""
    spark = rows.sparkSession
    (rows.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name))


def _remove_earlier(spark: SparkSession, name: str, size: int) -> DataFrame:
    blocks = lambda: spark.table(name).groupBy("block")
    left = spark.table(name).agg(F.sum("n")).first()[0] or 0
    buckets = lambda: max(1, -(-left // BUCKET_WINDOWS))
    sizes, before = lengths(size), 0
    length = next(sizes)
    pages = blocks().applyInArrow(_first(length, buckets()), STEPS)
    found = spark.createDataFrame([], FLAGS)
    while left:
        told = stored(pages.groupBy("bucket").applyInArrow(_meet, FLAGS), f"windows-told-{length}")
        after = next(sizes)
        if before:
            # the answers are stored: the pages that asked are of no more use
            delete(spark, f"{path}/kind=page")
            told = told.unionByName(state.where("n > 0").select("block", "bucket", F.col("candidates").alias("data")))
            step = spark.table(f"{name}_cut").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_next(length, after, buckets()), STEPS)
        else:
            step = blocks().cogroup(told.groupBy("block")).applyInArrow(_cut(length, after, buckets()), STEPS)
        path = f"{shared_dir(spark)}/windows-step-{length}-{uuid.uuid4().hex}"
        kind = F.when(F.col("bucket") >= 0, "page").when(F.col("bucket") == -1, "state").otherwise("cut")
        step.withColumn("kind", kind).write.option("compression", "zstd").partitionBy("kind").parquet(path)
        step = spark.read.schema(f"{STEPS.toDDL()}, kind string").parquet(path)
        pages, state = step.where("kind = 'page'"), step.where("kind = 'state'")
        if not before:
            cuts = step.where("kind = 'cut'").select(CUTS.names)
            _bucketed(cuts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block"), f"{name}_cut")
            delete(spark, f"{path}/kind=cut")
        found = found.unionByName(state.select("block", F.lit(length if before else 0).alias("bucket"), F.col("earlier").alias("data")))
        before, length, left = length, after, state.agg(F.sum("n")).first()[0] or 0
    out = blocks().cogroup(found.groupBy("block")).applyInArrow(_removed(size), T.StructType([
        T.StructField("doc_id", LONG), T.StructField("n_words", LONG), T.StructField("spans", SPANS), T.StructField("kept", STR)]))
    return stored(out, "windows-kept")


def _removed(size: int):
    return lambda docs, state: _remove(size, docs, state)


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_earlier(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (SELECT r, doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE doc_id IS NOT NULL)),
firsts AS (SELECT g, min(doc_id) AS low FROM wins GROUP BY g),
hit AS (SELECT r, list(p) AS ps FROM wins JOIN firsts USING (g) WHERE low < doc_id GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS i FROM (SELECT r, unnest(ps) AS p FROM hit)),
kept AS (SELECT d.r, list(x.v ORDER BY x.i) AS k FROM d, unnest(w) WITH ORDINALITY AS x(v, i) WHERE (d.r, x.i) NOT IN (SELECT r, i FROM gone) GROUP BY d.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(len(kept.k), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(kept.k, ' '), '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""
