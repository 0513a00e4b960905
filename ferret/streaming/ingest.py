"""ST1 / ST4 / ST5: result pages stream into the hit table.

``ingest_stream`` reads new files of a page source with a size-bounded trigger
(``maxFilesPerTrigger`` plays the role of the reference's queue flush point),
turns them into hits (S2/M1 via ``to_hits``) and writes each micro-batch to
the hit log (``foreachBatch``, idempotent per batch) and, if asked, into a
stored index (R2).  Nothing is ever dropped:
a full queue in the reference loses pages, a backlog here just waits.

``hits_view`` is the current hit table: the log folded by hit id with the last
batch winning (ST4 / M3).  ``refresh_candidates`` (ST5) joins a batch's
resource ids with the catalogue to find the ids to refresh (P5 + T10).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ferret.operators import catalog as CAT
from ferret.operators import index as IX
from ferret.operators.catalog import last_row
from ferret.session import children, materialize_small
from ferret.streaming.common import job_dir, read_log, write_batch, write_log


def ingest_stream(
    spark: SparkSession,
    source_path: str,
    schema,
    to_hits: Callable[[DataFrame], DataFrame],
    files_per_trigger: int = 16,
    name: str = "ingest",
    base: str | None = None,
    index: str | None = None,
    index_how: dict | None = None,
    source_format: str = "parquet",
) -> str:
    """Run the ingest stream until the source is drained; returns the hit-log path.

    Pass the ``base`` of an earlier run to resume it: the checkpoint skips the
    files already ingested, so only new pages are read.  ``index``: a folder in
    which every batch becomes a part of a stored index, written in proportion to
    the batch (:func:`ferret.operators.index.update_index`); a batch that is run
    again is found there and not added twice; ``index_how`` are arguments of
    :func:`ferret.operators.index.build_index`.  ``source_format``: how the files
    are read, such as ``text`` for raw result pages, one to a line.
    """
    base = base or job_dir(spark, name)
    log_path = f"{base}/hits"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(source_format).load(source_path)
    how = index_how or {}

    def take(df: DataFrame, bid: int) -> None:
        write_log(df, bid, log_path, ["hit_id"])
        if index is not None:
            hits = spark.read.parquet(log_path).filter(F.col("batch_id") == bid).drop("batch_id", "bucket")
            if current_index(spark, index) is None:
                IX.write_index(IX.build_index(hits, **how), index, bid)
            else:
                IX.update_index(hits, index, bid, **how)

    q = (
        to_hits(stream)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return log_path


def current_index(spark: SparkSession, index: str) -> IX.StoredIndex | None:
    """A stream's index as far as it has come, or none."""
    return IX.read_index(spark, index) if IX.has_index(spark, index) else None


def hits_view(spark: SparkSession, log_path: str, ids: DataFrame | None = None) -> DataFrame:
    """ST4: one row per hit id (or per one of ``ids``), from the last batch that wrote it."""
    return read_log(spark, log_path, ["hit_id"], ids).drop("batch_id")


def refresh_stream(
    spark: SparkSession,
    source_path: str,
    schema,
    to_seen: Callable[[DataFrame], DataFrame],
    catalog_path: str,
    answers: Callable[[DataFrame], DataFrame],
    seconds: int = CAT.STALE_REFRESH_SECONDS,
    budget: int = CAT.REFRESH_BUDGET,
    files_per_trigger: int = 16,
    base: str | None = None,
) -> str:
    """ST5: keep the catalogue fresh for the resources that a stream names; returns the folder of the job.

    ``to_seen`` turns the stream into (rid, ts).  A micro-batch reads the
    catalogue anew -- the stored one under ``catalog_path`` and what the batches
    before it refreshed --, takes its stale or unknown ids as of its last ``ts``
    (at most ``budget``, in id order) and asks ``answers``, a function from (id)
    to the resource versions that the parent knows.  What comes back under the
    id asked for is merged (M4) and saved; every id asked is logged under
    ``refreshed`` as (rid, found, asked).  Pass the ``base`` of an earlier run to
    resume it; a batch that is run again sees the catalogue that it saw and
    rewrites its own rows.
    """
    base = base or job_dir(spark, "refresh")

    def take(df: DataFrame, bid: int) -> None:
        session = df.sparkSession
        seen = to_seen(df).filter("rid is not null").groupBy("rid").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
        now = F.lit(seen.agg(F.max("ts")).first()[0]).cast("timestamp")
        catalog = refreshed_catalog(session, catalog_path, base, bid)
        asked = CAT.refresh_budget(CAT.stale(seen.select("rid", F.lit(bid).alias("batch_id")), catalog, seconds, now), "batch_id", [F.col("rid")], budget)
        asked = materialize_small(asked.select(F.col("rid").alias("id")))
        got = answers(asked).join(asked, "id", "left_semi")
        known = catalog.join(asked, "id", "left_semi")
        write_batch(CAT.merge_resources(known, got, now).join(got.select("id"), "id", "left_semi"), bid, f"{base}/catalog")
        found = got.select("id").distinct().withColumn("found", F.lit(True))
        write_batch(asked.join(found, "id", "left").select(F.col("id").alias("rid"), F.coalesce("found", F.lit(False)).alias("found"), now.alias("asked")), bid, f"{base}/refreshed")

    q = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_path)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return base


def refreshed_catalog(spark: SparkSession, catalog_path: str, base: str, before: int | None = None) -> DataFrame:
    """The stored catalogue (S4) with what the batches of a refresh job (older than ``before``) brought: the last update of each resource counts."""
    saved = CAT.conform(spark.read.parquet(catalog_path))
    if children(spark, f"{base}/catalog"):
        log = spark.read.schema(Ty.StructType([*CAT.CATALOG_SCHEMA.fields, Ty.StructField("batch_id", Ty.LongType())])).parquet(f"{base}/catalog")
        if before is not None:
            log = log.filter(F.col("batch_id") < before)
        saved = saved.unionByName(log.select(*CAT.COLUMNS))
    return last_row(saved, ["id"], ["lastupdated"])


def refresh_candidates(batch_rids: DataFrame, catalog: DataFrame, now: Column, seconds: int = CAT.STALE_REFRESH_SECONDS) -> DataFrame:
    """ST5: resource ids seen in a batch that are unknown or stale, at most 11
    per batch (in id order)."""
    stale = CAT.stale(batch_rids.select("rid", "batch_id").distinct(), catalog, seconds, now)
    return CAT.refresh_budget(stale, "batch_id", [F.col("rid")])
