"""Embedding near-duplicates through an inverted multi-index.

Unit vectors are cut into two halves; each half has its own codebook, and the
product of the two is a grid of cells.  A vector visits the grid's cells in
multi-sequence order, nearest first, for as many cells as the target recall
needs; that number is measured by brute force for a sample of queries against
all vectors.  Every query that has links counts alike, however many it has, so
a large group of near copies does not decide for the others; where too few
queries have links, all cells are visited.  Candidates are verified by cosine
in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferret.llm.common import DBL, INT, LONG, components, schema, stored, table

COSINE = 0.93
# Codebooks are fitted on about this many vectors; recall is measured with
# about this many queries against all vectors, and with more of the sample
# until this many have links.
SAMPLE, QUERIES, LINKED = 20_000, 500, 100
# Mean recall of the queries with links, and the recall that all but a small share of them reach.
TARGET_RECALL = 0.995
LOW_RECALL, LOW_SHARE = 0.95, 0.01
# Vectors per cell that the grid aims at, and the largest codebook.
PER_CELL, MAX_CODES = 256, 256
# Members and probes of a cell compared at once; larger cells are cut.
BLOCK = 2048
# Sums of distances held at once while cells are put in order.
VISIT_SUMS = 4_000_000


@dataclass
class Grid:
    """Codebooks by vector length: length -> (codes of the first half, codes of the second half)."""

    books: dict[int, tuple[np.ndarray, np.ndarray]]
    cells: int = 1

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = (unit.shape[1] + 1) // 2
        return tuple(((x ** 2).sum(1)[:, None] - 2 * x @ c.T + (c ** 2).sum(1)) if x.shape[1] else np.zeros((len(x), 1))
                     for x, c in zip((unit[:, :half], unit[:, half:]), self.books[unit.shape[1]]))

    def own(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(1) * b.shape[1] + b.argmin(1)

    def visit(self, unit: np.ndarray, cells: int) -> np.ndarray:
        """The ``cells`` nearest cells of each vector, nearest first (fewer in a smaller grid)."""
        codes = [len(c) for c in self.books[unit.shape[1]]]
        k = min(cells, codes[0] * codes[1])
        step = max(1, VISIT_SUMS // (min(k, codes[0]) * min(k, codes[1])))
        if len(unit) > step:
            return np.concatenate([self.visit(unit[i:i + step], cells) for i in range(0, len(unit), step)])
        a, b = self.distances(unit)
        # only the nearest ``cells`` codes of a half can take part in the first ``cells`` cells
        ia, ib = (np.argsort(d, axis=1, kind="stable")[:, :k] for d in (a, b))
        total = np.take_along_axis(a, ia, 1)[:, :, None] + np.take_along_axis(b, ib, 1)[:, None, :]
        cell = ia[:, :, None] * b.shape[1] + ib[:, None, :]
        order = np.argsort(total.reshape(len(unit), -1), axis=1, kind="stable")[:, :k]
        return np.take_along_axis(cell.reshape(len(unit), -1), order, 1)


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each vector length in a batch."""
    sizes = np.asarray(column.value_lengths())
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = np.asarray(column.take(pa.array(at)).flatten()).reshape(len(at), size).astype(np.float64)
        yield at, x / np.sqrt((x * x).sum(1))[:, None]


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(8):
        near = ((codes ** 2).sum(1) - 2 * x @ codes.T).argmin(1)
        for c in np.unique(near):
            codes[c] = x[near == c].mean(0)
    return codes


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v, h1, h2) of vectors that can link: labelled, finite, not zero."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                           F.col(vec_col).cast("array<double>").alias("v"))
            .where("vec_id is not null and label is not null and v is not null and size(v) > 0").where(~bad).where(norm > 0)
            .withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(11), "v")))


def fit(distinct: DataFrame, threshold: float) -> Grid:
    """Codebooks from a sample; the number of cells to visit from brute force over all vectors."""
    spark = distinct.sparkSession
    n = distinct.count()
    draw = F.pmod("h2", F.lit(1 << 30)) / float(1 << 30)
    sample = distinct.where(draw < min(1.0, SAMPLE / max(1, n))).select("label", "node", "v").collect()
    sample.sort(key=lambda r: (r.node, r.label))
    k = int(min(MAX_CODES, max(2, (n / PER_CELL) ** 0.5)))
    grid = Grid({})
    for size in {len(r.v) for r in sample}:
        x = np.array([r.v for r in sample if len(r.v) == size], np.float64)
        x /= np.sqrt((x * x).sum(1))[:, None]
        half = (size + 1) // 2
        grid.books[size] = (_kmeans(x[:, :half], k, 1), _kmeans(x[:, half:], k, 2) if size > 1 else np.zeros((1, 0)))
    # a length the sample lacks gets the one-cell grid: all its vectors meet
    for r in distinct.select(F.size("v").alias("s")).distinct().collect():
        grid.books.setdefault(r.s, (np.zeros((1, (r.s + 1) // 2)), np.zeros((1, r.s // 2))))
    grid.cells = _cells(distinct, grid, sample, threshold)
    return grid


def _ranks(distinct: DataFrame, grid: Grid, queries: list, threshold: float) -> DataFrame:
    """(q, rank, n): of query ``q``'s links to all vectors, how many stand in the ``rank``-th cell it would visit."""
    asked: dict[tuple[int, int], list] = {}
    for i, r in enumerate(queries):
        asked.setdefault((r.label, len(r.v)), []).append((i, r.node, r.v))
    wanted = {key: tuple(map(np.array, zip(*some))) for key, some in asked.items()}
    shared = distinct.sparkSession.sparkContext.broadcast((grid, wanted))

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, wanted = shared.value
        known = {}
        for key, (ids, nodes, q) in wanted.items():
            q = q / np.sqrt((q * q).sum(1))[:, None]
            known[key] = ids, nodes, q, *g.distances(q)
        place: dict[tuple[int, int], int] = {}
        for batch in batches:
            label, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            seen: dict[tuple[int, int], int] = {}
            for at, unit in _units(batch.column(2)):
                for lab in np.unique(label[at]):
                    if (lab, unit.shape[1]) not in known:
                        continue
                    ids, nodes, q, a, b = known[lab, unit.shape[1]]
                    here, u = node[at[label[at] == lab]], unit[label[at] == lab]
                    own = g.own(u)
                    for s in range(0, len(q), QUERIES):
                        i, j = np.nonzero((q[s:s + QUERIES] @ u.T >= threshold) & (nodes[s:s + QUERIES, None] != here))
                        pairs, count = np.unique(np.stack([i + s, own[j]]), axis=1, return_counts=True)
                        for x, cell, c in zip(*pairs.tolist(), count.tolist()):
                            if (ids[x], cell) not in place:
                                mine = a[x, cell // b.shape[1]] + b[x, cell % b.shape[1]]
                                place[ids[x], cell] = int((a[x][:, None] + b[x] <= mine).sum()) - 1
                            rank = place[ids[x], cell]
                            seen[ids[x], rank] = seen.get((ids[x], rank), 0) + c
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()),
                                              pa.array(list(seen.values()), pa.int64())], names=["q", "rank", "n"])

    return (distinct.select("label", "node", "v").mapInArrow(ranks, schema(q=INT, rank=INT, n=LONG))
            .groupBy("q", "rank").agg(F.sum("n").alias("n")))


def _cells(distinct: DataFrame, grid: Grid, sample: list, threshold: float) -> int:
    """Cells to visit, by the recall of each query that has links; all cells when too few have any."""
    order = np.random.default_rng(3).permutation(len(sample))
    whole = Window.partitionBy("q")
    found: dict[int, float] = {}
    content: dict[int, int] = {}
    linked, at, size = 0, 0, QUERIES
    while at < len(sample) and linked < LINKED:
        queries = [sample[i] for i in order[at:at + size]]
        at, size = at + size, size * 4
        one = _ranks(distinct, grid, queries, threshold).withColumn("all", F.sum("n").over(whole))
        one = stored(one.withColumn("upto", F.sum("n").over(whole.orderBy("rank"))), "vectors-ranks")
        for r in one.groupBy("rank").agg(F.sum(F.col("n") / F.col("all")).alias("part")).collect():
            found[r["rank"]] = found.get(r["rank"], 0.0) + r.part
        enough = one.where(F.col("upto") >= LOW_RECALL * F.col("all")).groupBy("q").agg(F.min("rank").alias("rank"))
        for r in enough.groupBy("rank").agg(F.count("*").alias("k")).collect():
            content[r["rank"]] = content.get(r["rank"], 0) + r.k
            linked += r.k
    if linked < LINKED:
        return max([1, *(len(a) * len(b) for a, b in grid.books.values())])
    cells = 4
    for reached, goal in ((found, TARGET_RECALL), (content, 1 - LOW_SHARE)):
        so_far = 0.0
        for rank in sorted(reached):
            so_far += reached[rank]
            cells = max(cells, rank + 1)
            if so_far >= goal * linked - 1e-9:
                break
    return cells


def _cell_links(threshold: float, key, members: pa.Table, probes: pa.Table) -> pa.Table:
    """Links between the members of a cell and the vectors that visit it.

    A pair counts for both ends once: for the visitor always, for the member
    only if it does not visit the visitor's cell itself.  Links leave as one
    edge per vector to the smallest id it reaches in here.
    """
    probes = probes.rename_columns([c.removeprefix("p_") for c in probes.column_names])
    out = {"node": [], "n": [], "to": []}
    if len(members) and len(probes):
        m, p = ({c: np.asarray(t[c].combine_chunks()) for c in ("node", "c", "own")} for t in (members, probes))
        mu, pu = (np.asarray(t["u"].combine_chunks().flatten()).reshape(len(t), -1) for t in (members, probes))
        visits = members["visits"].combine_chunks()
        visits = np.asarray(visits.flatten()).reshape(len(members), -1)
        link = (pu @ mu.T >= threshold) & (p["node"][:, None] != m["node"])
        for_p, for_m = link @ m["c"], np.zeros(len(members), np.int64)
        for own in np.unique(p["own"]):
            here = p["own"] == own
            for_m += np.where((visits == own).any(1), 0, p["c"][here] @ link[here])
        lp, lm = p["node"].copy(), m["node"].copy()
        most = np.iinfo(np.int64).max
        while True:
            np_ = np.minimum(lp, np.where(link, lm, most).min(1))
            nm = np.minimum(lm, np.where(link, np_[:, None], most).min(0))
            if (np_ == lp).all() and (nm == lm).all():
                break
            lp, lm = np_, nm
        for node, n, to in ((p["node"], for_p, lp), (m["node"], for_m, lm)):
            some = (n > 0) | (to != node)
            out["node"].append(node[some])
            out["n"].append(n[some])
            out["to"].append(to[some])
    cols = [np.concatenate([np.empty(0, np.int64), *out[c]]).astype(np.int64) for c in ("node", "n", "to")]
    return pa.table(dict(zip(("node", "n", "to"), map(pa.array, cols))))


def near_links(distinct: DataFrame, grid: Grid, threshold: float) -> DataFrame:
    """(node, n, to): partial counts of linked rows and an edge, from every cell that is visited."""
    spark = distinct.sparkSession
    shared = spark.sparkContext.broadcast(grid)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            for at, unit in _units(batch.column(3)):
                some = batch.take(pa.array(at))
                width = pa.array(np.full(len(at), unit.shape[1]), pa.int32())
                seq = g.visit(unit, g.cells)
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), some.column(2), width, pa.array(g.own(unit), pa.int64()),
                    pa.array(list(seq.astype(np.int64)), pa.list_(pa.int64())), pa.array(list(unit), pa.list_(pa.float64()))],
                    names=["label", "node", "c", "dim", "own", "visits", "u"])

    many = T.ArrayType(DBL)
    rows = stored(distinct.select("label", "node", "c", "v").mapInArrow(place, T.StructType([
        *schema(label=LONG, node=LONG, c=LONG, dim=INT, own=LONG).fields,
        T.StructField("visits", T.ArrayType(LONG)), T.StructField("u", many)])), "vectors-placed")
    probes = rows.withColumn("cell", F.explode("visits"))
    members = rows.withColumn("cell", F.col("own"))
    by = ["label", "dim", "cell"]
    # both sides of a large cell are cut into blocks, and every block meets every other
    cut = (members.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("mb"))
           .join(probes.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pb")), by))
    cut = stored(cut, "vectors-cells")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("node", F.lit(3)), F.col(c)).cast("int")
    members = members.join(cut, by).withColumn("i", part("mb")).withColumn("j", upto("pb"))
    probes = probes.join(cut, by).withColumn("j", part("pb")).withColumn("i", upto("mb"))
    left = members.select(*by, "i", "j", "node", "c", "own", "visits", "u")
    right = probes.select(*[F.col(c).alias(f"p_{c}") for c in (*by, "i", "j", "node", "c", "own", "u")])
    return (left.groupBy(*by, "i", "j").cogroup(right.groupBy(*[f"p_{c}" for c in (*by, "i", "j")]))
            .applyInArrow(lambda key, a, b: _cell_links(threshold, key, a, b), schema(node=LONG, n=LONG, to=LONG)))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link only within a label and a length.  Null labels and null, empty,
    zero or non-finite vectors link with nothing.  Equal vectors are one node:
    each counts the others as links.  Rows of one id and different vectors
    share their links.  A row without an id links with nothing and is not kept.
    """
    rows = stored(usable(vectors, id_col, vec_col, label_col), "vectors-usable")
    key = ["label", "h1", "h2"]
    distinct = stored(rows.groupBy(*key).agg(F.min("vec_id").alias("node"), F.count("*").alias("c"), F.first("v").alias("v")), "vectors-distinct")
    parts = stored(near_links(distinct, fit(distinct, threshold), threshold), "vectors-links")
    counts = parts.groupBy("node").agg(F.sum("n").alias("n"))
    member = rows.join(distinct.select(*key, "node", "c"), key).select("vec_id", "node", "c")
    edges = parts.select(F.col("node").alias("a"), F.col("to").alias("b")).unionByName(
        member.where("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b")))
    comp = components(edges, name="vectors-cc")
    full = (member.join(counts, "node", "left").groupBy("vec_id")
            .agg(F.max(F.col("c") - 1 + F.coalesce("n", F.lit(0))).alias("n")))
    one = (full.join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left"))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(one, "vec_id", "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"),
                    F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept")))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
