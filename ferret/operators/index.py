"""The inverted index as ordinary tables.

``postings(field, term, hit_id)`` holds one row per distinct term of a hit in
each indexed field (``terms`` = every string value of the hit, ``title``).
Document frequencies come from a grouped count with map-side partial
aggregation, so a hot term costs one partial row per task before the shuffle.

For repeated use, :func:`write_index` stores the postings clustered by term, so
a search reads only the row groups of its terms.  :func:`update_index` adds a
batch as a part of its own, with a table of the hits it replaces and signed
counts, so an update writes what the batch holds; parts of one size are merged
into larger ones.  A search over all parts equals one over a rebuilt index.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferret.functions import text as T
from ferret.session import children, delete

FIELDS = ("terms", "title")


@dataclass
class Index:
    postings: DataFrame  # field, term, hit_id
    docs: DataFrame  # hit_id plus the stored hit columns

    def n_docs(self) -> Column:
        """N, the number of indexed hits, as a scalar sub-query column."""
        return self.docs.select(F.count(F.lit(1))).scalar()


def build_index(hits: DataFrame, text_cols=("title", "description", "url", "rid", "type"), tasks: int | None = None, members: str | None = None) -> Index:
    """R2: index every hit that has a title.

    The indexed text (F6) is made of ``text_cols``, or of all values of the map
    column ``members``, whatever their names.

    Both fields are tokenized in one pass over the text: one ``explode`` of an
    array of (field, term) structs.  ``tasks`` deals the hits to that many tasks
    first (a shuffle of the texts): of use only where a table is one row group.
    """
    # hit_id is never null; saying so up front keeps the filter Spark would
    # infer for a later join on hit_id out of the shared subplan
    indexable = hits.filter(F.col("title").isNotNull() & F.col("hit_id").isNotNull())
    if tasks:
        indexable = indexable.repartition(tasks, F.xxhash64("hit_id"))
    tagged = F.concat(
        F.transform(T.analyze_distinct(T.hit_text(*text_cols) if members is None else F.array_join(F.map_values(members), " ")), lambda t: F.struct(F.lit("terms").alias("field"), t.alias("term"))),
        F.transform(T.analyze_distinct("title"), lambda t: F.struct(F.lit("title").alias("field"), t.alias("term"))),
    )
    postings = indexable.select(F.inline(tagged), "hit_id")
    return Index(postings=postings, docs=indexable)


def document_frequency(postings: DataFrame) -> DataFrame:
    """Number of hits per (field, term)."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column, n: Column) -> Column:
    """``ln(1 + (N - df + 0.5) / (df + 0.5))``."""
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_stats(index: Index) -> DataFrame:
    """Df, N and idf per (field, term)."""
    n = index.n_docs()
    return document_frequency(index.postings).select(
        "field", "term", "df", n.alias("n"), idf(F.col("df"), n).alias("idf")
    )


@dataclass
class StoredIndex:
    """An index as tables: a first part and any number of later ones (:func:`read_index`).

    Every posting and document carries the version ``ver`` that wrote it;
    ``gone`` names the hits that a later version replaced.  ``stats`` holds
    signed counts whose sum is the document frequency of live postings, ``n``
    signed numbers of hits.
    """

    postings: DataFrame  # field, term, hit_id, ver  (files sorted by term)
    stats: DataFrame  # field, term, df (one row per term and part)
    n: DataFrame  # n (one row per part)
    docs: DataFrame  # the stored hit columns, ver
    gone: DataFrame | None  # hit_id, upto: rows of the hit older than this version are dead

    def live(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` (hit_id, ver, ...) that no later version replaced."""
        if self.gone is None:
            return rows
        dead = self.gone.groupBy(F.col("hit_id").alias("_hit")).agg(F.max("upto").alias("_upto"))
        return rows.join(dead, (F.col("hit_id") == F.col("_hit")) & (F.col("ver") < F.col("_upto")), "left_anti")

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """Live postings (field, term, hit_id) of a table of terms; no other term is read past the scan."""
        return self.live(self.postings.join(terms, "term", "left_semi")).select("field", "term", "hit_id")

    def df(self, terms: DataFrame) -> DataFrame:
        """Document frequency per (field, term) of a table of terms."""
        some = self.stats.join(terms, "term", "left_semi")
        return some.groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df > 0")

    def n_docs(self) -> Column:
        return self.n.agg(F.sum("n")).scalar()

    def count(self) -> int:
        """The number of hits, from one row per part."""
        return self.n.agg(F.sum("n")).first()[0] or 0

    def with_columns(self, top: DataFrame, cols: list[str]) -> DataFrame:
        """``top`` with stored columns of its hits."""
        return self.live(top.join(self.docs.select("hit_id", "ver", *cols), "hit_id")).drop("ver")


# Parts of about one size that are merged into the next size (see :func:`merge_tiers`).
FAN = 4
PART = re.compile(r"part_(\d+)_(\d+)")


def _parts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) version of every finished part; a part is finished when its ``n`` is, which is written last."""
    out = []
    for name in children(spark, path):
        m = PART.fullmatch(name)
        if m and "_SUCCESS" in children(spark, f"{path}/{name}/n"):
            out.append((int(m.group(1)), int(m.group(2))))
    return sorted(out)


def has_index(spark: SparkSession, path: str) -> bool:
    return bool(_parts(spark, path))


def _cover(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts that are not merged into another one, oldest first."""
    return [p for p in parts if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in parts)]


def _write_part(path: str, part: tuple[int, int], postings: DataFrame, docs: DataFrame, gone: DataFrame | None) -> str:
    """Store the tables of a part but its statistics; returns its folder.

    The postings are clustered by (field, term): the parquet min/max statistics
    let a scan for a few terms skip most row groups.  Spark sizes the files from
    the measured shuffle (AQE advisory partition size).
    """
    at = f"{path}/part_{part[0]}_{part[1]}"
    postings.repartition("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{at}/postings")
    docs.write.mode("overwrite").parquet(f"{at}/docs")
    if gone is not None:
        gone.write.mode("overwrite").parquet(f"{at}/gone")
    return at


def _postings(spark: SparkSession, *at: str) -> DataFrame:
    # the schema is given: a batch without indexable hits may leave a folder without files
    return spark.read.schema("field string, term string, hit_id string, ver long").parquet(*[f"{x}/postings" for x in at])


def _finish_part(at: str, stats: DataFrame, n: Column | int, spark: SparkSession) -> None:
    stats.write.mode("overwrite").parquet(f"{at}/stats")
    rows = _postings(spark, at).agg(F.count(F.lit(1)).alias("rows"))
    rows.select(F.lit(n).cast("long").alias("n"), "rows").write.mode("overwrite").parquet(f"{at}/n")


def write_index(index: Index, path: str, version: int = 0) -> None:
    """Store an index under ``path`` as its first part (earlier parts there go).

    The texts are tokenized once, into postings; document frequencies are then
    counted from what was written.
    """
    spark = index.postings.sparkSession
    for name in children(spark, path):
        if PART.fullmatch(name):
            delete(spark, f"{path}/{name}")
    ver = F.lit(version).cast("long").alias("ver")
    at = _write_part(path, (version, version), index.postings.select("*", ver), index.docs.select("*", ver), None)
    written = spark.read.parquet(f"{at}/docs").count()
    _finish_part(at, document_frequency(_postings(spark, at)), written, spark)


def read_index(spark: SparkSession, path: str, before: int | None = None) -> StoredIndex:
    """The index under ``path``, or as it was before a version."""
    parts = [p for p in _parts(spark, path) if before is None or p[1] < before]
    return _open(spark, path, _cover(parts))


def _open(spark: SparkSession, path: str, parts: list[tuple[int, int]], gone_of: list[tuple[int, int]] | None = None) -> StoredIndex:
    if not parts:
        raise ValueError(f"no index under {path}")
    at = [f"{path}/part_{a}_{b}" for a, b in parts]
    replaced = [x for x in (f"{path}/part_{a}_{b}" for a, b in gone_of or parts) if "gone" in children(spark, x)]
    return StoredIndex(
        postings=_postings(spark, *at),
        stats=spark.read.schema("field string, term string, df long").parquet(*[f"{x}/stats" for x in at]),
        n=spark.read.schema("n long, rows long").parquet(*[f"{x}/n" for x in at]),
        docs=spark.read.option("mergeSchema", "true").parquet(*[f"{x}/docs" for x in at]),
        gone=spark.read.schema("hit_id string, upto long").parquet(*[f"{x}/gone" for x in replaced]) if replaced else None,
    )


def update_index(hits: DataFrame, path: str, version: int | None = None, fan: int = FAN, **how) -> StoredIndex:
    """Add ``hits`` to the index under ``path`` or replace them there (by hit_id); one row per hit.

    Writes a part in proportion to the batch: its postings and hits, the ids it
    replaces, and signed counts: one up per new posting, one down per posting of
    a replaced hit (its stored text is tokenized again, with the same ``how`` as
    the index).  Older parts are read, never rewritten, but for the merges of
    :func:`merge_tiers`, which follow.  A ``version`` that is already part of
    the index is not added again, so a repeated batch changes nothing.
    """
    spark = hits.sparkSession
    parts = _parts(spark, path)
    version = parts[-1][1] + 1 if version is None else version
    if not any(a <= version <= b for a, b in parts):
        before = read_index(spark, path, version)
        ver = F.lit(version).cast("long").alias("ver")
        new = build_index(hits, **how)
        replaced = before.live(before.docs.join(hits.select("hit_id").distinct(), "hit_id", "left_semi"))
        at = _write_part(path, (version, version), new.postings.select("*", ver), new.docs.select("*", ver),
                         replaced.select("hit_id", F.lit(version).cast("long").alias("upto")))
        gone = spark.read.parquet(f"{at}/gone")
        old = build_index(before.live(before.docs.join(gone, "hit_id", "left_semi")).drop("ver"), **how)
        down = document_frequency(old.postings).select("field", "term", (-F.col("df")).alias("df"))
        up = document_frequency(_postings(spark, at))
        stats = up.unionByName(down).groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
        _finish_part(at, stats, spark.read.parquet(f"{at}/docs").count() - gone.count(), spark)
        merge_tiers(spark, path, fan)
    return read_index(spark, path)


def tail_to_merge(rows: list[int], fan: int = FAN) -> int:
    """How many of the newest parts (``rows`` postings each, oldest first) to merge: once
    ``fan`` of a size class have gathered, these and the smaller ones after them."""
    tiers = [int(math.log(max(r, 1), fan)) for r in rows]
    for t in sorted(set(tiers)):
        k = next((k for k, x in enumerate(reversed(tiers)) if x > t), len(tiers))
        if k and tiers[-k:].count(t) >= fan:
            return k
    return 0


def merge_tiers(spark: SparkSession, path: str, fan: int = FAN) -> None:
    """Merge the newest parts of about one size into one part, so that ``n`` batches
    leave a number of parts logarithmic in ``n`` and every posting is written
    again a logarithmic number of times.

    Dead postings and hits are left out.  Parts that an earlier merge made
    needless are deleted first; those of this merge stay until the next one, for
    readers that are still on them.
    """
    parts = _parts(spark, path)
    cover = _cover(parts)
    for p in parts:
        if p not in cover:
            delete(spark, f"{path}/part_{p[0]}_{p[1]}")
    # one row per part
    rows = [spark.read.parquet(f"{path}/part_{a}_{b}/n").first().rows for a, b in cover]
    k = tail_to_merge(rows, fan)
    if k:
        merge_parts(spark, path, cover[-k:])


def merge_parts(spark: SparkSession, path: str, parts: list[tuple[int, int]] | None = None) -> None:
    """Merge neighbouring parts (all by default) into one."""
    cover = _cover(_parts(spark, path))
    parts = parts or cover
    if len(parts) < 2:
        return
    whole = _open(spark, path, parts, cover)
    gone = whole.gone
    if gone is not None:
        # what replaced hits of older parts still counts
        older = parts[0] != cover[0]
        gone = gone.groupBy("hit_id").agg(F.max("upto").alias("upto")).filter(F.lit(older))
    at = _write_part(path, (parts[0][0], parts[-1][1]), whole.live(whole.postings), whole.live(whole.docs), gone)
    stats = whole.stats.groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
    _finish_part(at, stats, whole.n.agg(F.sum("n")).first()[0], spark)


def with_default_hit(hits: DataFrame, hit: dict[str, str] | None) -> DataFrame:
    """U4: one built-in hit that is always part of the index (none: no change).

    ``hit``: its string members, ``url`` (or ``title``) for its identity."""
    if not hit:
        return hits
    row = hits.sparkSession.createDataFrame([tuple(hit.values())], ", ".join(f"{k} string" for k in hit))
    missing = [F.lit(None).cast("string").alias(c) for c in ("rid", "url", "title") if c not in hit]
    row = row.select("*", *missing)
    return hits.unionByName(row.withColumn("hit_id", T.hit_id(F.col("rid"), F.col("url"), F.col("title"))), allowMissingColumns=True)
