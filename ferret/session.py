"""Session helpers: configuration, checkpoint folder.

Nothing in the library creates a session by itself except :func:`get_spark`,
which tests, ``bench.py`` and scripts use.  Operators only take DataFrames.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

def get_spark(app: str = "ferret", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FERRET_DRIVER_MEMORY", "16g"))
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a folder every executor can reach, and it
    must be set.  Only a local session (tests), where driver and executors are
    one process, gets a temporary folder when it is empty.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="ferret-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads; none if it is absent."""
    fs, at = _folder(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that the library itself wrote; an absent one is no error."""
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def text_tasks(spark: SparkSession) -> int | None:
    """``ferret.text.tasks``: tasks to which the registered queries deal whole
    texts before tokenizing.  Unset (the default), a scan's own splits are used."""
    value = spark.conf.get("ferret.text.tasks", None)
    return int(value) if value else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize_small(df: DataFrame) -> DataFrame:
    """Compute a small derived table once and cut its lineage.

    For dimension-sized tables (a catalogue of resources, a vocabulary) built
    from a large scan and used by several branches of a plan: ``checkpoint()``
    writes them to the shared checkpoint folder (reliable storage, survives
    lost executors), so the large scan runs once instead of once per branch.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
