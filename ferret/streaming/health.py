"""ST3: resource health kept up to date from a stream of answers.

A streaming ``groupBy(rid).agg(...)`` in update mode: each micro-batch emits
only the resources whose counters changed, appended to a log; the current
health table is the log folded by rid (last batch wins).  State is one row per
resource in the state store, so the job survives restarts from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferret.operators.health import resource_counters
from ferret.streaming.common import job_dir, latest, write_batch


def health_stream(
    spark: SparkSession,
    source_path: str,
    schema,
    to_log: Callable[[DataFrame], DataFrame],
    files_per_trigger: int = 16,
    base: str | None = None,
) -> str:
    """Run until the source is drained; returns the path of the health log.

    Pass the ``base`` of an earlier run to resume it with its counters.
    """
    base = base or job_dir(spark, "health")
    out = f"{base}/health"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_path)
    q = (
        resource_counters(to_log(stream))
        .writeStream.outputMode("update")
        .foreachBatch(lambda df, bid: write_batch(df, bid, out))
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return out


def health_view(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark.read.parquet(path), ["rid"]).drop("batch_id")
