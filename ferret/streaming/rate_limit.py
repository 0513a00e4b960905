"""ST2: per-resource token bucket, as a batch fold and as a stream.

State per resource: allowance (starts at 500) and the time of last use.  Each
request adds ``elapsed_ms / 86,400,000 * rate``, capped at ``rate``; above 1 it
is accepted and costs 1, otherwise rejected.

The rule is a strict sequence per resource, so it cannot be split into
independent pieces.  Requests are hash-partitioned by resource and sorted by
time inside each partition; ``mapInPandas`` walks each partition's Arrow
batches in order and carries the state across batches.  A resource with a third
of all requests is streamed through, never gathered into one group.  The stream
runs the same fold on each micro-batch, starting from the state table that the
batch before it wrote; :func:`rate_limit_stateful` keeps the buckets in Spark's
state store instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Fixed values of the limiter.
DAY_MS = 86_400_000
START_ALLOWANCE = 500.0
DEFAULT_RATE = 1000

OUT_SCHEMA = "req_id long, rid string, ts timestamp, ms long, allowance double, accepted boolean"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cur = None
    allowance = 0.0
    last = 0
    for pdf in batches:
        n = len(pdf)
        rid = pdf["rid"].to_numpy()
        ms = pdf["ms"].to_numpy(dtype=np.int64)
        rate = pdf["rate"].to_numpy(dtype=np.float64)
        # state before the first request: nan for a resource not seen before
        start = pdf["start"].to_numpy(dtype=np.float64)
        since = pdf["since"].to_numpy(dtype=np.float64)
        out_a = np.empty(n, dtype=np.float64)
        out_ok = np.empty(n, dtype=bool)
        for i in range(n):
            if rid[i] != cur:
                cur = rid[i]
                allowance, last = (START_ALLOWANCE, ms[i]) if np.isnan(start[i]) else (start[i], int(since[i]))
            allowance += ((ms[i] - last) / DAY_MS) * rate[i]
            last = ms[i]
            if allowance > rate[i]:
                allowance = rate[i]
            out_ok[i] = allowance > 1
            if out_ok[i]:
                allowance -= 1
            out_a[i] = allowance
        yield pd.DataFrame({
            "req_id": pdf["req_id"], "rid": pdf["rid"], "ts": pdf["ts"], "ms": ms, "allowance": out_a, "accepted": out_ok,
        })


def _requests(requests: DataFrame, rate) -> DataFrame:
    r = requests if "rate" in requests.columns else requests.withColumn("rate", F.lit(rate))
    return r.select("req_id", "rid", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("rate").cast("double").alias("rate"))


def _run(requests: DataFrame, state: DataFrame | None) -> DataFrame:
    """Verdicts of requests (:func:`_requests`) from ``state`` (rid, allowance, last_ms)."""
    if state is None:
        r = requests.withColumn("start", F.lit(None).cast("double")).withColumn("since", F.lit(None).cast("double"))
    else:
        s = state.select("rid", F.col("allowance").alias("start"), F.col("last_ms").cast("double").alias("since"))
        r = requests.join(s, "rid", "left")
    return r.repartition("rid").sortWithinPartitions("rid", "ts", "req_id").mapInPandas(_fold, OUT_SCHEMA)


def rate_limit(requests: DataFrame, rate=DEFAULT_RATE) -> DataFrame:
    """ST2 (batch): (req_id, rid, ts, allowance, accepted) for every request.

    ``requests``: (req_id, rid, ts[, rate]).  Time order within a resource is
    (ts, req_id).  Elapsed time is counted in whole milliseconds.
    """
    return _run(_requests(requests, rate), None).drop("ms")


def bucket_state(verdicts: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(rid, allowance, last_ms) after the last request of each resource in
    ``verdicts``; resources without one keep their state ``before``."""
    last = verdicts.groupBy("rid").agg(F.max(F.struct("ts", "req_id", "allowance", "ms")).alias("s"))
    new = last.select("rid", F.col("s.allowance").alias("allowance"), F.col("s.ms").alias("last_ms"))
    return new if before is None else new.unionByName(before.select("rid", "allowance", "last_ms").join(new, "rid", "left_anti"))


def rate_limit_stream(spark, source_path: str, schema, to_requests, rate=DEFAULT_RATE, files_per_trigger: int = 16,
                      base: str | None = None) -> str:
    """ST2 (stream): run the token bucket over a request stream until drained;
    returns the path of the verdict log.

    Pass the ``base`` of an earlier run to resume it: every bucket goes on from
    the state table of its last batch.  Micro-batches are taken in arrival
    order, requests of one batch in (ts, req_id) order; a batch that is run
    again reads the same state and rewrites its own verdicts and state.
    """
    from ferret.streaming.common import job_dir, write_batch

    base = base or job_dir(spark, "rate-limit")
    out, state_path = f"{base}/verdicts", f"{base}/state"

    def take(df: DataFrame, bid: int) -> None:
        spark_ = df.sparkSession
        before = None
        if bid > 0:
            state = spark_.read.schema("rid string, allowance double, last_ms long, batch_id long").parquet(state_path)
            before = state.filter(F.col("batch_id") == bid - 1)
        write_batch(_run(_requests(to_requests(df), rate), before), bid, out)
        done = spark_.read.schema(OUT_SCHEMA + ", batch_id long").parquet(out).filter(F.col("batch_id") == bid)
        write_batch(bucket_state(done, before), bid, state_path)

    q = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_path)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return out


# --- the same rule as keyed state of the stream ---------------------------------

STATEFUL_SCHEMA = "req_id long, rid string, ts timestamp, allowance double, accepted boolean"
# Requests of one resource turned into rows at once.
ROWS = 50_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TokenBucket(StatefulProcessor):
    """The bucket of one resource, kept in the state store between micro-batches.

    The requests of a micro-batch arrive in no order, so their times and ids (a
    few numbers a request, bounded by the trigger) are sorted before the fold.
    """

    def init(self, handle) -> None:
        self.bucket = handle.getValueState("bucket", "allowance double, last_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "req_id"], kind="stable", ignore_index=True)
        start, since = self.bucket.get() if self.bucket.exists() else (np.nan, np.nan)
        got["start"], got["since"] = start, since
        for out in _fold(got[i:i + ROWS] for i in range(0, len(got), ROWS)):
            last = (float(out["allowance"].iloc[-1]), int(out["ms"].iloc[-1]))
            yield out[["req_id", "rid", "ts", "allowance", "accepted"]]
        self.bucket.update(last)

    def close(self) -> None:
        pass


def rate_limit_stateful(spark, source_path: str, schema, to_requests, rate=DEFAULT_RATE, files_per_trigger: int = 1000, base: str | None = None) -> str:
    """ST2 (stream): the token bucket as keyed state; returns the folder of the job.

    Verdicts (``STATEFUL_SCHEMA``) are appended under ``verdicts``, the buckets
    live in the state store under ``checkpoint``: a micro-batch touches the
    buckets of its own resources only, and state and verdicts are committed
    together, so a batch that is run again gives nothing twice.  Pass the
    ``base`` of an earlier run to resume it.  :func:`stored_buckets` reads the
    buckets back.  Spark's default state store has no place for such state, so
    where a session has that one the job runs with RocksDB.
    """
    from ferret.streaming.common import job_dir

    base = base or job_dir(spark, "rate-limit-state")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_path)
    provider = spark.conf.get(PROVIDER, None)
    if provider is None or provider.endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = (
            _requests(to_requests(stream), rate).groupBy("rid")
            .transformWithStateInPandas(TokenBucket(), outputStructType=STATEFUL_SCHEMA, outputMode="Append", timeMode="None")
            .writeStream.format("parquet").outputMode("append").option("path", f"{base}/verdicts")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if provider is None else spark.conf.set(PROVIDER, provider)
    return base


def stored_buckets(spark, base: str) -> DataFrame:
    """(rid, allowance, last_ms) of every resource, read from the state store of :func:`rate_limit_stateful`."""
    state = spark.read.format("statestore").option("stateVarName", "bucket").load(f"{base}/checkpoint")
    return state.select("key.rid", "value.allowance", "value.last_ms")
