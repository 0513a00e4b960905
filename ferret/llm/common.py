"""Shared helpers of the text and vector operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of one Arrow batch handed to a Python worker.  Texts have no bounded
# length, so batches are limited by bytes and not only by rows.
ARROW_BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Every executor must reach it, so it is never invented on a cluster: only a
    local session (tests), where driver and executors are one process, gets a
    temporary folder when the setting is empty.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="ferret-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage (a lost executor costs no recomputation of earlier
    stages) and gives later joins the measured size of the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_batches(spark: SparkSession) -> None:
    """Limit the Arrow batches of this session by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


# Rows of ids (at most two longs each, so 16 MB) up to which a stored table is
# shipped to every task; beyond it the same join is a shuffle join.
SHIPPED_ROWS = 1_000_000


def shipped(df: DataFrame) -> DataFrame:
    """Mark a stored table of ids for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.limit(SHIPPED_ROWS + 1).count() <= SHIPPED_ROWS else df


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (murmur3) on a uint64 array."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """Connected components of an undirected edge list, all in Spark.

    Returns (node, component): one row per node that has an edge, component =
    the smallest node of its component.  Large-star / small-star rounds on a
    written edge table; every round is a grouped minimum (map-side combined)
    and a join on the node, so no component is ever gathered.  Self loops and
    null ends are ignored.
    """
    spark = edges.sparkSession
    cur = (edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
           .where("u is not null and v is not null and u <> v")
           .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    cur = stored(cur, f"{name}-edges")
    last = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u points at u's minimum
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: u and its smaller neighbours point at the smallest one
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        cur = stored(small, f"{name}-round")
        mark = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    # a fixed point is a forest of stars: every node points at its minimum
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


LONG, INT, STR, BIN, DBL = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType(), T.DoubleType()


def schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


def class_sample(rows: DataFrame, cls: str, key: str | list[str], per_class: int, seed: int = 7) -> DataFrame:
    """About ``per_class`` rows of every class, chosen by a hash of ``key``, which should tell the rows apart.

    The rows per class are counted first (one row per class reaches the
    driver); the same rows are taken on every run and at any partitioning.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(cls).isNotNull()).groupBy(cls).count().collect()}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for c, n in sorted(counts.items()) for x in (c, min(1.0, per_class / n))])
    draw = F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key), F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return rows.where(draw < share[F.col(cls)])
