"""Exact n-gram Jaccard join with signature trees.

Texts become sets of hashed word shingles; equal sets are one node.  Sets that
can reach the threshold must share one of their first shingles in one order of
all shingles (prefix), so only sets that meet in such a shingle are compared.
The order is that of hashes, but shingles found common by a count over all
texts come last, the most common at the end: a line that a tenth of all texts
hold makes no meeting of them.  Any order gives the same links, so the count
need not be exact.  Each meeting
is a signature tree: leaves and inner nodes hold OR-combined bitmaps and size
ranges, and a dual traversal drops node pairs whose largest possible overlap
is too small.  What is left is verified on whole texts.

Groups of thousands of near copies are first tied together by verified links
to a few pivots; pairs inside one component need no further comparison, so no
group is ever expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferret.llm.common import BIN, DBL, INT, LONG, byte_batches, components, mix64, schema, shipped, stored, table, text_or_empty

SHINGLE = 5
# Similarity in hundredths: 100 * |A and B| >= SIMILAR * |A or B|.
SIMILAR = 80
# Pivot keys per set (independent minima).
PIVOTS = 3
# Bits of a bitmap: the next power of two above BITS_PER * size, within bounds.
BITS_PER, MIN_BITS, MAX_BITS = 4, 64, 8192
FAN = 32
# Groups of at most this many sets are compared pair by pair, without a tree.
FEW = 16
# Shingles that a batch of texts holds less often are not counted, of the others
# those counted so often in all texts, the first so many of them, are common.
COUNTED, COMMON, COMMONS = 3, 256, 50_000
# Pairs of nodes of two trees looked at together.
STEP = 1 << 13
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class Shingler:
    """Whole text -> sorted distinct 64-bit hashes of its word shingles."""

    def __init__(self, k: int = SHINGLE):
        self.k = k
        self.weights = np.array([pow(0xD6E8FEB86659FD93, i, 1 << 64) for i in range(k)], np.uint64)

    def words(self, text: str) -> np.ndarray:
        # on bytes, lower() changes A-Z only and split() cuts at blanks 09-0D and 20
        # every word is hashed anew: a table of known words is no faster and fills a worker
        return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, text.encode("utf-8").lower().split())), ">u8").astype(np.uint64)

    def runs(self, h: np.ndarray) -> np.ndarray:
        """Sorted hashes of the shingles of ``k`` or more hashed words, repeats included."""
        out = np.zeros(len(h) - self.k + 1, np.uint64)
        for i in range(self.k):
            out += h[i:len(h) - self.k + 1 + i] * self.weights[i]
        return np.sort(mix64(out))

    def __call__(self, text: str) -> np.ndarray:
        h = self.words(text)
        if not len(h):
            return h
        if len(h) < self.k:
            # the number of words is part of the hash of a short text
            return mix64((h * self.weights[:len(h)]).sum(dtype=np.uint64, keepdims=True) ^ SEEDS[[0]] * np.uint64(len(h)))
        out = self.runs(h)
        return out[np.append(True, out[1:] != out[:-1])]


def prefix_size(n: int, similar: int = SIMILAR) -> int:
    """Shingles of which a similar set must share at least one."""
    return n - -(-similar * n // 100) + 1 if n else 0


def n_bits(n: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER * n - 1).bit_length()))


def bitmap(h: np.ndarray) -> bytes:
    bits = np.zeros(n_bits(len(h)), bool)
    bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _counts(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that a batch of texts, taken as one text, holds ``COUNTED`` times or more, and how often."""
    shingles = Shingler(k)
    for batch in batches:
        h = [shingles.words(text) for text in batch.column(0).to_pylist()]
        if sum(map(len, h)) >= k:
            h = shingles.runs(np.concatenate(h))
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n = np.diff(np.append(at, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(h[at][n >= COUNTED].view(np.int64)), pa.array(n[n >= COUNTED])], names=["key", "c"])


def common_shingles(docs: DataFrame, k: int, text_col: str) -> np.ndarray:
    """Hashes of the common shingles of all texts, the most common last; at most ``COMMONS`` reach the driver."""
    byte_batches(docs.sparkSession)
    counts = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(partial(_counts, k), schema(key=LONG, c=LONG))
    most = counts.groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON).orderBy(F.desc("c"), "key").limit(COMMONS)
    return np.array([r.key for r in most.collect()][::-1], np.int64).view(np.uint64)


class Order:
    """Puts the sorted hashes of a set into the order of all shingles: those of ``common`` last, as they stand there."""

    def __init__(self, common: np.ndarray):
        self.place = np.argsort(common)
        self.keys = common[self.place]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return h
        at = np.searchsorted(self.keys, h).clip(max=len(self.keys) - 1)
        known = self.keys[at] == h
        return h[np.argsort(np.where(known, self.place[at] + 1, 0), kind="stable")] if known.any() else h


def _sets(k: int, similar: int, common: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles, order = Shingler(k), Order(common)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = shingles(text)
            raw = h.tobytes()
            rows.append((doc_id, len(h), xxhash.xxh3_128_digest(raw) if len(h) else None,
                         order(h)[:prefix_size(len(h), similar)].view(np.int64),
                         [int(mix64(h ^ s).min().astype(np.int64)) for s in SEEDS[:PIVOTS]] if len(h) else [],
                         bitmap(h) if len(h) else None))
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (
            pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))],
            names=["doc_id", "n", "print", "prefix", "pivots", "sig"])


def shingle_sets(docs: DataFrame, k: int, similar: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, print, prefix, pivots, sig) of every row; ``print`` is a 128-bit fingerprint of the set."""
    common = common_shingles(docs, k, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        partial(_sets, k, similar, common), T.StructType([
            *schema(doc_id=LONG, n=INT, print=BIN).fields,
            T.StructField("prefix", T.ArrayType(LONG)), T.StructField("pivots", T.ArrayType(LONG)), T.StructField("sig", BIN)]))


def _verify(k: int, similar: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles, last, a = Shingler(k), None, None
    for batch in batches:
        keep = []
        for i, (x, tx, ty) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)))):
            if x != last:
                last, a = x, shingles(tx)
            b = shingles(ty)
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= similar * (len(a) + len(b) - both):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def verify(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """Pairs (a, b) of a stored table whose whole texts (node, text) reach the threshold."""
    byte_batches(pairs.sparkSession)
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "jaccard-ends")
    side = texts.join(shipped(nodes), "node", "left_semi")
    both = (pairs.join(side.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
            .join(side.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb"))
    return stored(both.mapInArrow(partial(_verify, k, similar), schema(a=LONG, b=LONG)), "jaccard-links")


class Tree:
    """Bitmaps of a group by level: level 0 holds the sets, each higher node ORs ``FAN`` nodes below."""

    def __init__(self, sig: np.ndarray, n: np.ndarray, comp: np.ndarray):
        lost = n - np.bitwise_count(sig).sum(axis=1).astype(np.int64)
        # smallest and largest size, most collisions inside a bitmap, range of components
        self.levels = [(sig, n, n, lost, comp, comp)]
        while len(self.levels[-1][0]) > 1:
            s, lo, hi, c, c0, c1 = self.levels[-1]
            cut = np.arange(0, len(s), FAN)
            self.levels.append((np.bitwise_or.reduceat(s, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut),
                                np.maximum.reduceat(c, cut), np.minimum.reduceat(c0, cut), np.maximum.reduceat(c1, cut)))


def fold(sig: np.ndarray, words: int) -> np.ndarray:
    while sig.shape[1] > words:
        half = sig.shape[1] // 2
        sig = sig[:, :half] | sig[:, half:]
    return sig


def dual(x: Tree, y: Tree, similar: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets (i of x, j of y) that no bound excludes, with their bound; sets of one component are no pair."""
    # node pairs are followed down a few at a time, so what is held does not grow with their number
    zero = np.zeros(1, np.int64)
    todo, found = [(len(x.levels) - 1, len(y.levels) - 1, zero, zero)], [(zero[:0], zero[:0], np.zeros(0))]
    while todo:
        lx, ly, i, j = todo.pop()
        sx, nx, hx, cx, px, qx = x.levels[lx]
        sy, ny, hy, cy, py, qy = y.levels[ly]
        # sizes within the threshold, and not one and the same component on both sides
        ok = (100 * hx[i] >= similar * ny[j]) & (100 * hy[j] >= similar * nx[i])
        ok &= ~((px[i] == qx[i]) & (py[j] == qy[j]) & (px[i] == py[j]))
        if x is y and lx == ly:
            ok &= i <= j
        i, j = i[ok], j[ok]
        # common bits, and common shingles that share a bit with another one
        most = np.bitwise_count(sx[i] & sy[j]).sum(axis=1).astype(np.int64) + np.minimum(cx[i], cy[j])
        ok = (100 + similar) * most >= similar * (nx[i] + ny[j])
        if not (lx or ly):
            found.append((i[ok], j[ok], most[ok] / (nx[i] + ny[j] - most)[ok].clip(1)))
            continue
        a, b = i[ok], j[ok]
        if lx >= ly:
            lx -= 1
            kids = a[:, None] * FAN + np.arange(FAN)
            b = np.repeat(b, FAN)[(kids < len(x.levels[lx][0])).ravel()]
            a = kids.ravel()[(kids < len(x.levels[lx][0])).ravel()]
        else:
            ly -= 1
            kids = b[:, None] * FAN + np.arange(FAN)
            a = np.repeat(a, FAN)[(kids < len(y.levels[ly][0])).ravel()]
            b = kids.ravel()[(kids < len(y.levels[ly][0])).ravel()]
        todo.extend((lx, ly, a[at:at + STEP], b[at:at + STEP]) for at in range(0, len(a), STEP))
    return tuple(np.concatenate(x) for x in zip(*found))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by key -> tables of whole groups and where their groups begin and end."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not len(t):
            continue
        key = np.asarray(t["key"].combine_chunks())
        end = int(np.searchsorted(key, key[-1]))
        rest = t.slice(end)
        if end:
            yield t.slice(0, end), np.concatenate([[0], np.flatnonzero(np.diff(key[:end])) + 1, [end]])
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def _size_pairs(similar: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of small groups -> pairs of sets of different components whose sizes allow the threshold, once per batch."""
    for t, cuts in _whole_groups(batches):
        node, n, comp = (t[c].to_pylist() for c in ("node", "n", "comp"))
        out = set()
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            for i in range(s + 1, e):
                for j in range(s, i):
                    low, high = (n[i], n[j]) if n[i] < n[j] else (n[j], n[i])
                    if comp[i] != comp[j] and node[i] != node[j] and 100 * low >= similar * high:
                        out.add((node[i], node[j], comp[i], comp[j], n[i], n[j]) if node[i] < node[j] else
                                (node[j], node[i], comp[j], comp[i], n[j], n[i]))
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["a", "b", "ca", "cb", "na", "nb"])


def largest_overlap(n: int, m: int, x: bytes, y: bytes) -> int:
    """Most shingles that sets of ``n`` and ``m`` with bitmaps ``x`` and ``y`` can share."""
    p, q, size, other = int.from_bytes(x, "little"), int.from_bytes(y, "little"), len(x) * 8, len(y) * 8
    if size > other:
        p, q, size, other = q, p, other, size
        n, m = m, n
    while other > size:
        other //= 2
        q = (q & ((1 << other) - 1)) | (q >> other)
    return (p & q).bit_count() + min(n - p.bit_count(), m - q.bit_count())


def _bounds(similar: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both bitmaps -> those that the bitmaps do not exclude, with the bound on their similarity."""
    for batch in batches:
        keep, bound = [], []
        for k, (na, nb, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")))):
            most = largest_overlap(na, nb, x, y)
            if (100 + similar) * most >= similar * (na + nb):
                keep.append(k)
                bound.append(most / (na + nb - most))
        some = batch.select(["a", "b", "ca", "cb"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(bound, pa.float64())], names=["a", "b", "ca", "cb", "bound"])


def _match(node, n, comp, sigs, similar: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of one group, and whether a pair is the likeliest of its sets towards the other component."""
    order = np.lexsort((comp, n))
    node, n, comp = node[order], n[order], comp[order]
    sigs = [sigs[k] for k in order]
    size = np.array([len(s) for s in sigs])
    sides = {w: np.flatnonzero(size == w) for w in np.unique(size)}
    bits = {w: np.frombuffer(b"".join([sigs[k] for k in at]), np.uint64).reshape(len(at), -1) for w, at in sides.items()}
    out = []
    for w, at in sides.items():
        low = Tree(bits[w], n[at], comp[at])
        for w2, at2 in sides.items():
            if w2 >= w and n[at2].min() * similar <= 100 * n[at].max():
                high = low if w2 == w else Tree(fold(bits[w2], bits[w].shape[1]), n[at2], comp[at2])
                i, j, v = dual(low, high, similar)
                out.append((at[i], at2[j], v))
    a, b, v = (np.concatenate(x) for x in zip(*out))
    ok = (node[a] != node[b]) & (comp[a] != comp[b])
    a, b, v = a[ok], b[ok], v[ok]
    order = np.lexsort((b, a, -v))
    a, b = a[order], b[order]
    best = np.zeros(len(a), bool)
    if len(a):
        _, one = np.unique(np.column_stack([node[a], comp[b]]), axis=0, return_index=True)
        _, two = np.unique(np.column_stack([node[b], comp[a]]), axis=0, return_index=True)
        best[np.intersect1d(one, two)] = True
    return np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), best


def _groups(similar: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large groups, sorted by key -> candidate pairs of the trees."""
    for t, cuts in _whole_groups(batches):
        node, n, comp = (np.asarray(t[c].combine_chunks()).astype(np.int64) for c in ("node", "n", "comp"))
        sigs = t["sig"].to_pylist()
        found = [_match(node[s:e], n[s:e], comp[s:e], sigs[s:e], similar) for s, e in zip(cuts[:-1], cuts[1:]) if e - s > 1]
        if found:
            a, b, best = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(best)], names=["a", "b", "best"])


def links(sets: DataFrame, texts: DataFrame, k: int, similar: int) -> DataFrame:
    """Edges (a, b) that join exactly the documents that any path of links joins."""
    # equal sets are tied to their smallest id, which alone is compared further
    known = sets.where("n > 0 and doc_id is not null")
    same = known.groupBy("print").agg(F.min("doc_id").alias("p"), F.count("*").alias("c")).where("c > 1").select("print", "p")
    copies = stored(known.select("print", "doc_id").join(same, "print").where("doc_id <> p")
                    .select(F.col("doc_id").alias("a"), F.col("p").alias("b")).distinct(), "jaccard-copies")
    known = known.withColumnRenamed("doc_id", "node")
    # pivots: a set is tied to the smallest set that shares one of its minima
    at = known.select("node", F.explode("pivots").alias("m")).distinct()
    least = at.groupBy("m").agg(F.min("node").alias("p"), F.count("*").alias("c")).where("c > 1").select("m", "p")
    stars = (at.join(shipped(copies.select(F.col("a").alias("node"))), "node", "left_anti").join(least, "m").where("node <> p")
             .select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct())
    found = stored(copies.unionByName(verify(stored(stars, "jaccard-stars"), texts, k, similar)), "jaccard-found")
    # every meeting in a prefix shingle of sets of different components
    comp = stored(components(found, name="jaccard-cc"), "jaccard-comp")
    one = known.join(shipped(copies.select(F.col("a").alias("node"))), "node", "left_anti")
    rows = (one.join(shipped(comp), "node", "left")
            .select("node", F.coalesce("component", "node").alias("comp"), "n", F.explode("prefix").alias("key")))
    # a set needs a neighbour by size within the threshold, and its key two components
    by = Window.partitionBy("key")
    size = by.orderBy("n")
    rows = rows.withColumn("next", F.lead("n").over(size)).withColumn("prev", F.lag("n").over(size))
    rows = rows.where((100 * F.col("n") >= similar * F.col("next")) | (100 * F.col("prev") >= similar * F.col("n")))
    live = (rows.withColumn("lo", F.min("comp").over(by)).withColumn("hi", F.max("comp").over(by))
            .where("lo <> hi").select("key", "node", "n", "comp"))
    live = stored(live.withColumn("size", F.count("*").over(by)), "jaccard-live")
    # small groups: pairs by size first, once for all keys they share, then by their bitmaps
    sigs = known.select("node", "sig")
    near = (live.where(F.col("size") <= FEW).select("key", "node", "n", "comp").repartition("key").sortWithinPartitions("key")
            .mapInArrow(partial(_size_pairs, similar), schema(a=LONG, b=LONG, ca=LONG, cb=LONG, na=LONG, nb=LONG)).distinct())
    near = (near.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("xa")), "a")
            .join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("xb")), "b")
            .mapInArrow(partial(_bounds, similar), schema(a=LONG, b=LONG, ca=LONG, cb=LONG, bound=DBL)))
    first = lambda x, c, y: F.row_number().over(Window.partitionBy(x, c).orderBy(F.desc("bound"), y)) == 1
    near = near.select("a", "b", (first("a", "cb", "b") & first("b", "ca", "a")).alias("best"))
    # large groups: a signature tree each
    wide = live.where(F.col("size") > FEW).join(sigs, "node").select("key", "node", "n", "comp", "sig")
    wide = (wide.repartition("key").sortWithinPartitions("key")
            .mapInArrow(partial(_groups, similar), T.StructType([*schema(a=LONG, b=LONG).fields, T.StructField("best", T.BooleanType())])))
    pairs = near.unionByName(wide).groupBy("a", "b").agg(F.max("best").alias("best"))
    pairs = stored(pairs, "jaccard-pairs")
    # the likeliest pair between two components first: most others are then inside one component
    found = stored(found.unionByName(verify(pairs.where("best").select("a", "b"), texts, k, similar)), "jaccard-found")
    comp = stored(components(found, name="jaccard-cc"), "jaccard-comp")
    rest = (pairs.where("not best").select("a", "b")
            .join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
            .join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            .where("ca is null or cb is null or ca <> cb").select("a", "b"))
    return found.unionByName(verify(stored(rest, "jaccard-rest"), texts, k, similar))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                       similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Null texts and texts without words have no shingles and link with nothing;
    a text of fewer than ``k`` words is one shingle.  Rows of one id are one
    document; a row without an id links with nothing and has no component.
    Only the two named columns are read.
    """
    sets = stored(shingle_sets(docs, k, similar, id_col, text_col), "jaccard-sets")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), text_or_empty(text_col).alias("text"))
    comp = stored(components(stored(links(sets, texts, k, similar), "jaccard-all"), name="jaccard-cc"), "jaccard-comp")
    return (sets.select("doc_id", "n").join(shipped(comp.withColumnRenamed("node", "doc_id")), "doc_id", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.coalesce("component", "doc_id").alias("component_id")))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q USING (k) WHERE p.doc_id <> q.doc_id GROUP BY ALL) x
      JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * c >= 80 * (za.n + zb.n - c)),
r AS (WITH RECURSIVE t(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b) SELECT a, min(b) AS c FROM t GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, r.c AS component_id FROM d LEFT JOIN z USING (doc_id) JOIN r ON r.a = d.doc_id
"""
