"""Sinks and exports (S5-S10): JSON projections of hits, result pages,
catalogue and health, and the incremental catalogue save.

Projections are ordinary columns first (so they can be checked and joined);
``to_json`` turns a projection into text, dropping nulls.
Private parameters never appear in an export (they are only in the stored
catalogue written by :func:`write_catalog`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferret.functions import health as H
from ferret.functions import text as T
from ferret.operators import catalog as CAT

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
START_ALLOWANCE = 500.0
SHARED_FIELDS = [
    "id", "name", "urltemplate", "favicon", "banner", "post", "postencode", "mimetype", "rerank", "signature",
    "testquery", "itempath", "type", "apitemplate", "suggesttemplate", "directaccess",
]
UNSHARED_FIELDS = ["name", "urltemplate", "favicon", "banner", "directaccess", "rerank", "type"]


def export_hits(hits: DataFrame, cols: list[str]) -> DataFrame:
    """One JSON line per hit (no cap)."""
    return hits.select(F.to_json(F.struct(*cols)).alias("value"))


def result_page(hits: DataFrame, keys: list[str], censor: bool = False) -> DataFrame:
    """One JSON page per ``keys`` group: ``{"hits": [...]}`` in ``pos`` order.

    String members are HTML-stripped again; ``censor`` drops ``query`` and
    ``rid``.  A page is one search answer, so its size is bounded by the page
    limits (80 hits, 30 items) that produced it.
    """
    fields = [c for c in hits.columns if c not in keys and c != "pos"]
    if censor:
        fields = [c for c in fields if c not in ("query", "rid")]
    types = dict(hits.dtypes)
    vals = [(T.strip_html(c) if types[c] == "string" else F.col(c)).alias(c) for c in fields]
    g = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("pos"), F.struct(*vals).alias("h")))).alias("l"))
    return g.select(*keys, F.to_json(F.struct(F.transform("l", lambda x: x["h"]).alias("hits"))).alias("json"))


def _not_default(c: str, default) -> Column:
    return F.when(F.col(c) != F.lit(default), F.col(c))


def catalog_shared(catalog: DataFrame) -> DataFrame:
    """S8 (shared): all members but private parameters; a tombstone is id +
    deleted only; ``maxqueriesperday`` only when not 1000; prior as is."""
    c = CAT.conform(catalog)
    gone = F.col("deleted")
    cols = [F.col("id")]
    cols += [F.when(~gone, F.col(f)).alias(f) for f in SHARED_FIELDS if f != "id"]
    cols += [
        F.when(gone, F.lit(True)).alias("deleted"),
        F.when(~gone, F.col("prior")).alias("prior"),
        F.when(~gone, _not_default("maxqueriesperday", CAT.DEFAULT_RATE)).alias("maxqueriesperday"),
        F.when(~gone, F.col("extractors")).alias("extractors"),
        F.when(~gone, F.col("headers")).alias("headers"),
    ]
    return c.select(*cols)


def catalog_unshared(catalog: DataFrame) -> DataFrame:
    """S8 (not shared): public members only; a tombstone is id + deleted; the
    mimetype and the rate only if they are not the default."""
    c = CAT.conform(catalog)
    live = ~F.col("deleted")
    return c.select(
        "id",
        F.when(~live, F.lit(True)).alias("deleted"),
        *[F.when(live, F.col(f)).alias(f) for f in UNSHARED_FIELDS],
        F.when(live, _not_default("mimetype", CAT.DEFAULT_MIMETYPE)).alias("mimetype"),
        F.when(live, _not_default("maxqueriesperday", CAT.DEFAULT_RATE)).alias("maxqueriesperday"),
    )


def to_json_lines(projection: DataFrame) -> DataFrame:
    """Text form of a projection: nulls are omitted by ``to_json``."""
    return projection.select(F.to_json(F.struct(*projection.columns)).alias("value"))


def health_export(catalog: DataFrame, health: DataFrame, limits: DataFrame, now: Column) -> DataFrame:
    """Health of every catalogue resource, times as ``yyyy-MM-dd HH:mm:ss``.

    ``health``: counters by rid (A3); ``limits``: (rid, allowance, ts), the state
    of the rate limiter after its last request.  A resource without answers has
    zero counters and its start as both times; one without limiter state has
    its start allowance.  The allowance is what is left at ``now`` (F19).
    """
    c = CAT.conform(catalog).select(F.col("id").alias("rid"), "upsince", "lastupdated", "maxqueriesperday")
    h = health.select("rid", "requestsok", "requestserr", "lastsuccess", "lasterror", "lastmessage")
    x = c.join(h, "rid", "left").join(limits.select("rid", "allowance", "ts"), "rid", "left")
    stamp = lambda col: F.date_format(F.coalesce(col, F.col("upsince")), TS_FORMAT)
    return x.select(
        "rid",
        F.coalesce("requestsok", F.lit(0)).alias("requestsok"),
        F.coalesce("requestserr", F.lit(0)).alias("requestserr"),
        H.allowance(F.coalesce("allowance", F.lit(START_ALLOWANCE)), F.coalesce("ts", "upsince"),
                    F.col("maxqueriesperday"), now).alias("dayallowance"),
        stamp(F.col("lastsuccess")).alias("lastsuccess"),
        stamp(F.col("lasterror")).alias("lasterror"),
        stamp(F.col("lastupdated")).alias("lastupdated"),
        F.date_format("upsince", TS_FORMAT).alias("upsince"),
        "lastmessage",
    )


def local_projection(mother: DataFrame) -> DataFrame:
    """The local description inherits id, name, banner, favicon,
    suggesttemplate and testquery of the mother; mimetype is the default."""
    m = CAT.conform(mother)
    return m.select("id", "name", "banner", "favicon", "suggesttemplate", "testquery", F.lit(CAT.DEFAULT_MIMETYPE).alias("mimetype"))


def write_catalog(catalog: DataFrame, since: Column, path: str) -> DataFrame:
    """Save the resources updated at or after ``since`` (a same-second update
    is never missed); returns the new high-water mark as a one-row DataFrame.

    A save is the partition of its mark: the same save made again replaces it.
    Rows at the mark that an earlier save holds too are folded on reading
    (:func:`ferret.sources.pages.read_catalog`); :func:`compact_catalog` folds
    them on disk.
    """
    changed = catalog.filter(F.col("lastupdated") >= since)
    (changed.withColumn("saved_since", F.date_format(since, "yyyyMMddHHmmss")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("saved_since").parquet(path))
    return changed.agg(F.max("lastupdated").alias("since"))


def compact_catalog(spark: SparkSession, path: str, into: str) -> None:
    """Write the folded catalogue of all saves under ``path`` as one save under ``into``."""
    from ferret.sources.pages import read_catalog

    catalog, _ = read_catalog(spark, path)
    catalog.withColumn("saved_since", F.lit("0")).write.mode("overwrite").partitionBy("saved_since").parquet(into)
