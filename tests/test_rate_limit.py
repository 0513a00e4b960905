"""ST2: the batch fold and the stream against a plain simulation."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ferret.streaming import rate_limit as RL


def simulate(rows, rate):
    out, state = {}, {}
    for req_id, rid, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        ms = int(ts.timestamp() * 1000) if ts.tzinfo else int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
        a, last = state.get(rid, (500.0, ms))
        a += ((ms - last) / 86400000) * rate
        a = min(a, rate)
        ok = a > 1
        if ok:
            a -= 1
        state[rid] = (a, ms)
        out[req_id] = ok
    return out


def requests(n=3000, seed=3):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        rid = "hot" if rnd.random() < 0.34 else f"r{rnd.randrange(20)}"
        rows.append((i, rid, t0 + dt.timedelta(seconds=rnd.randrange(30 * 86400))))
    return rows


def test_batch_matches_simulation(spark):
    rows = requests()
    df = spark.createDataFrame(rows, "req_id long, rid string, ts timestamp")
    got = {r.req_id: r.accepted for r in RL.rate_limit(df, rate=20).collect()}
    assert got == simulate(rows, 20)
    assert 0 < sum(got.values()) < len(rows)


def test_stream_matches_batch(spark, tmp_path):
    rows = requests(800, seed=5)
    df = spark.createDataFrame(rows, "req_id long, rid string, ts timestamp")
    src = str(tmp_path / "src")
    df.write.parquet(src)
    path = RL.rate_limit_stream(spark, src, df.schema, lambda s: s, rate=30)
    got = {r.req_id: r.accepted for r in spark.read.parquet(path).collect()}
    assert got == simulate(rows, 30)


def test_stream_of_four_batches_with_a_restart(spark, tmp_path):
    rows = sorted(requests(600, seed=9), key=lambda r: r[2])
    src, base = tmp_path / "src", str(tmp_path / "job")
    path = None
    for k in range(4):
        part = rows[k * 150:(k + 1) * 150]
        df = spark.createDataFrame(part, "req_id long, rid string, ts timestamp").coalesce(1)
        df.write.parquet(str(src / f"p{k}"))
        if k in (1, 3):  # two runs; two files each, one file per micro-batch
            path = RL.rate_limit_stream(spark, f"{src}/*", df.schema, lambda s: s, rate=25, files_per_trigger=1, base=base)
    log = spark.read.parquet(path)
    assert log.select("batch_id").distinct().count() == 4
    got = {r.req_id: r.accepted for r in log.collect()}
    # files of one run may be taken in either order, so compare with a walk in batch order
    order = sorted(((r.batch_id, r.rid, r.ts, r.req_id) for r in log.collect()))
    state, want = {}, {}
    for _, rid, ts, req in order:
        ms = int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
        a, last = state.get(rid, (500.0, ms))
        a = min(a + (ms - last) / 86400000 * 25, 25)
        want[req] = a > 1
        state[rid] = (a - 1 if a > 1 else a, ms)
    assert got == want and len(got) == 600


def test_start_allowance_and_own_rates(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, "big", t0, 1000) for k in range(503)] + [(1000 + k, "small", t0, 3) for k in range(6)],
                               "req_id long, rid string, ts timestamp, rate int")
    got = RL.rate_limit(df).groupBy("rid").agg(F.count_if("accepted").alias("n")).collect()
    # 500 at the start (the last unit is never spent); a lower rate caps the start
    assert {r.rid: r.n for r in got} == {"big": 499, "small": 2}


def test_state_store_equals_the_batch(spark, tmp_path):
    """Keyed state over three micro-batches and as many starts; requests of a batch in no order; one hot resource."""
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(900):
        rid = "hot" if rng.random() < 0.4 else f"r{rng.randrange(12)}"
        rows.append((k, rid, start + dt.timedelta(seconds=k * 700 + rng.randrange(600)), rng.choice([1, 2, 400])))
    schema = "req_id long, rid string, ts timestamp, rate int"
    src, base = str(tmp_path / "src"), None
    for k in range(3):
        part = rows[k * 300:(k + 1) * 300]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).repartition(4).write.parquet(f"{src}/p{k}")
        base = RL.rate_limit_stateful(spark, f"{src}/*", spark.read.parquet(f"{src}/p{k}").schema, lambda df: df, base=base)
        assert RL.stored_buckets(spark, base).count() == len({r[1] for r in rows[:(k + 1) * 300]})
    key = lambda r: (r.req_id, r.rid, r.ts, round(r.allowance, 9), r.accepted)
    want = RL.rate_limit(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(key, spark.read.parquet(f"{base}/verdicts").collect())) == sorted(map(key, want))
    last = {}
    for r in sorted(want, key=lambda r: (r.ts, r.req_id)):
        last[r.rid] = round(r.allowance, 9)
    assert {r.rid: round(r.allowance, 9) for r in RL.stored_buckets(spark, base).collect()} == last
    # nothing new: nothing is written again
    RL.rate_limit_stateful(spark, f"{src}/*", spark.read.parquet(f"{src}/p0").schema, lambda df: df, base=base)
    assert spark.read.parquet(f"{base}/verdicts").count() == len(rows)


def test_stateful_query_takes_times_without_a_zone(spark, tmp_path):
    """Events whose times are timestamp_ntz: cut into equal spans, with the verdicts of the batch."""
    from ferret.plans import registry

    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(hours=k), k % 3) for k in range(30)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    src, write = registry._event_slices(spark, str(tmp_path), 3)
    for k in range(3):
        write(k)
    assert {r["slice"]: r["count"] for r in spark.read.parquet(src).groupBy("slice").count().collect()} == {0: 10, 1: 10, 2: 10}
    got = registry.q_rate_limit_stateful(spark, str(tmp_path))
    want = RL.rate_limit(events.select(F.col("event_id").alias("req_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("rid"), "ts"), rate=2)
    assert dict(got.dtypes)["ts"] == "timestamp"
    key = lambda r: (r.req_id, r.rid, r.ts, round(r.allowance, 5), r.accepted)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.select("req_id", "rid", "ts", registry.f6("allowance"), "accepted").collect()))


def test_stateful_query_in_a_session_with_the_default_state_store(spark, tmp_path):
    """A session that nobody prepared: the query runs, its buckets are read back, the session is left as it was."""
    from ferret.plans import registry

    t0 = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(k, t0 + dt.timedelta(hours=k), k % 2) for k in range(12)], "event_id long, ts timestamp, user_id long")
    events.write.parquet(f"{tmp_path}/events.parquet")
    want = RL.rate_limit(events.select(F.col("event_id").alias("req_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("rid"), "ts"), rate=2)
    before, default = spark.conf.get(RL.PROVIDER), RL.ROCKSDB.replace("RocksDB", "HDFSBacked")
    try:
        spark.conf.set(RL.PROVIDER, default)
        got = registry.q_rate_limit_stateful(spark, str(tmp_path)).collect()
        assert spark.conf.get(RL.PROVIDER) == default
    finally:
        spark.conf.set(RL.PROVIDER, before)
    assert {r.req_id: (r.rid, r.accepted) for r in got} == {r.req_id: (r.rid, r.accepted) for r in want.collect()}
    assert {r.req_id: r.left for r in got if r.left is not None} == {r.req_id: r.allowance for r in got if r.req_id >= 10}
