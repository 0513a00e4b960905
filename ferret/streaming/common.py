"""Shared helpers for the streaming jobs: state and output folders, run-to-end.

Every stream keeps its checkpoint and output under the shared folder named by
``spark.checkpoint.dir`` (a folder all executors reach on a cluster), one
sub-folder per job: a fresh one, or the ``base`` that an earlier run returned
with :func:`job_dir`, from which a restarted job resumes.

Tables written by streams are append-only logs of micro-batch outputs,
partitioned by ``batch_id``; a batch rewritten after a failure replaces its
own partition only (``partitionOverwriteMode=dynamic``), which makes every
``foreachBatch`` idempotent.  Readers take the last row per key in the order
(batch, row hash), which Spark limits to one row per key and task before the
shuffle; :func:`compact` writes that view as a log of one batch.

The hit log lies in hash buckets of its key as well (:func:`write_log`): what is
folded, looked up or compacted is a bucket, not the log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferret.operators.catalog import last_row
from ferret.session import checkpoint_dir, children, delete


def job_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/ferret-streams/{name}-{uuid.uuid4().hex[:12]}"


def write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """Idempotent micro-batch write: the batch's own partition is replaced."""
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def latest(log: DataFrame, key: list[str]) -> DataFrame:
    """Fold an append-only batch log: the last batch's row per key (see
    :func:`ferret.operators.catalog.last_row` for two rows of one batch)."""
    return last_row(log, key, ["batch_id"])


def compact(spark: SparkSession, path: str, key: list[str], into: str) -> None:
    """Write the folded log as one batch (the last one) under ``into``."""
    log = spark.read.parquet(path)
    last = log.agg(F.max("batch_id")).first()[0]
    if last is not None:
        write_batch(latest(log, key).drop("batch_id"), last, into)


# --- a log in hash buckets of its key --------------------------------------------

# Buckets of a log: a batch or a lookup touches those of its keys only.
BUCKETS = 32


def _bucket(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def write_log(df: DataFrame, batch_id: int, path: str, key: list[str], buckets: int = BUCKETS) -> None:
    """Idempotent micro-batch write into ``bucket=<b>/batch_id=<n>``, one row per key
    (the last one in the order of :func:`ferret.operators.catalog.last_row`).

    A log keeps the number of buckets it was begun with.
    """
    rows = last_row(df, key, []).withColumn("bucket", _bucket(key, buckets)).withColumn("batch_id", F.lit(batch_id).cast("long"))
    (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(path))


def log_batches(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The batches that each bucket of a log holds (a listing of folders)."""
    named = lambda at, what: sorted(int(x.split("=")[1]) for x in children(spark, at) if x.startswith(f"{what}="))
    return {b: named(f"{path}/bucket={b}", "batch_id") for b in named(path, "bucket")}


def read_log(spark: SparkSession, path: str, key: list[str], wanted: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The last batch's row per key, or of the keys in ``wanted`` only.

    Buckets that hold one batch are passed on as they are; the others are folded
    by batch number alone, as a batch has one row per key.  A lookup reads the
    buckets of its keys only (at most ``buckets`` numbers reach the driver).
    """
    held = log_batches(spark, path)
    log = spark.read.parquet(path)
    if wanted is not None:
        wanted = wanted.select(*key).distinct()
        used = {r[0] for r in wanted.select(_bucket(key, buckets)).distinct().collect()}
        held = {b: n for b, n in held.items() if b in used}
        log = log.join(wanted, key, "left_semi")
    one = [b for b, n in held.items() if len(n) == 1]
    more = [b for b, n in held.items() if len(n) > 1]
    w = Window.partitionBy(*key).orderBy(F.col("batch_id").desc())
    folded = log.filter(F.col("bucket").isin(more)).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return log.filter(F.col("bucket").isin(one)).unionByName(folded).drop("bucket")


def compact_log(spark: SparkSession, path: str, key: list[str], most: int = 4) -> list[int]:
    """Fold the buckets that hold more than ``most`` batches into their last one each; returns these buckets.

    The folded rows take the place of the last batch; only then the older
    batches go, so a reader (or a job that ends in between) finds the same last
    rows at any time.  Other buckets are not touched.
    """
    due = {b: n for b, n in log_batches(spark, path).items() if len(n) > most}
    if due:
        w = Window.partitionBy(*key).orderBy(F.col("batch_id").desc())
        rows = spark.read.parquet(path).filter(F.col("bucket").isin(list(due))).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
        last = F.create_map(*[F.lit(x) for b, n in due.items() for x in (b, n[-1])])
        # written aside first: a table cannot be overwritten while it is read
        aside = f"{path}-fold-{uuid.uuid4().hex[:12]}"
        rows.withColumn("batch_id", last[F.col("bucket")].cast("long")).write.parquet(aside)
        (spark.read.parquet(aside).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "batch_id").parquet(path))
        for b, n in due.items():
            for old in n[:-1]:
                delete(spark, f"{path}/bucket={b}/batch_id={old}")
        delete(spark, aside)
    return sorted(due)
