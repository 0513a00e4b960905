"""Streams: restarted jobs resume from their checkpoints, the hit view keeps the
last writer per hit id, and a stream's index equals one built at once."""

import datetime as dt

from pyspark.sql import functions as F

from ferret.operators import catalog as CAT
from ferret.operators import index as IX
from ferret.operators import search as S
from ferret.sources import exports as EX
from ferret.sources import pages as PG
from ferret.streaming import common as C
from ferret.streaming import health as SH
from ferret.streaming import ingest as SI

SCHEMA = "hit_id string, title string"


def test_ingest_resumes_and_upserts(spark, tmp_path):
    src = str(tmp_path / "src")
    base = str(tmp_path / "job")
    spark.createDataFrame([("a", "A1"), ("b", "B1")], SCHEMA).coalesce(1).write.parquet(f"{src}/p1")
    schema = spark.read.parquet(f"{src}/p1").schema
    path = SI.ingest_stream(spark, f"{src}/*", schema, lambda df: df, base=base)
    assert {r.hit_id: r.title for r in SI.hits_view(spark, path).collect()} == {"a": "A1", "b": "B1"}
    spark.createDataFrame([("a", "A2"), ("c", "C1")], SCHEMA).coalesce(1).write.parquet(f"{src}/p2")
    path2 = SI.ingest_stream(spark, f"{src}/*", schema, lambda df: df, base=base)
    assert path2 == path
    log = spark.read.parquet(path)
    assert log.select("batch_id").distinct().count() == 2  # the second run read only the new file
    assert {r.hit_id: r.title for r in SI.hits_view(spark, path).collect()} == {"a": "A2", "b": "B1", "c": "C1"}
    assert C.compact_log(spark, path, ["hit_id"], most=1)
    assert {r.hit_id: r.title for r in SI.hits_view(spark, path).collect()} == {"a": "A2", "b": "B1", "c": "C1"}


def test_two_rows_of_one_key_in_a_batch_give_one_winner(spark, tmp_path):
    rows = [("a", f"T{k}", 1) for k in range(20)]
    views = set()
    for n in (1, 5):
        C.write_log(spark.createDataFrame(rows, "hit_id string, title string, x int").repartition(n), 0, f"{tmp_path}/{n}", ["hit_id"])
        views.add(SI.hits_view(spark, f"{tmp_path}/{n}").first().title)
    assert len(views) == 1


def test_ingest_keeps_an_index(spark, tmp_path):
    cols = "hit_id string, rid string, url string, title string, description string, type string"
    one = [("r@1", "r", "u1", "Red apples", "grow here", "web"), ("r@2", "r", "u2", "Pears", "green pears", "web")]
    two = [("r@2", "r", "u2", "Plums", "blue plums", "web"), ("r@3", "r", "u3", "Apples", "more apples", "web")]
    src, base, index = str(tmp_path / "src"), str(tmp_path / "job"), str(tmp_path / "index")
    for k, part in enumerate((one, two)):
        spark.createDataFrame(part, cols).coalesce(1).write.parquet(f"{src}/p{k}")
        path = SI.ingest_stream(spark, f"{src}/*", spark.read.parquet(f"{src}/p{k}").schema, lambda df: df, base=base, index=index)
    q = spark.createDataFrame([(1, "apples"), (2, "pears"), (3, "plums")], "qid long, query string")
    cut = lambda df: sorted((r.qid, r.rank, r.hit_id, round(r.score, 9)) for r in df.collect())
    got = cut(S.search_stored(q, SI.current_index(spark, index)))
    assert got == cut(S.search(q, IX.build_index(SI.hits_view(spark, path)))) and {g[0] for g in got} == {1, 3}


def test_health_stream_resumes_with_its_counters(spark, tmp_path):
    src, base = str(tmp_path / "src"), str(tmp_path / "job")
    cols = "event_id long, rid string, ts timestamp, error boolean, hits int, message string"
    for k in range(3):
        t = dt.datetime(2024, 1, 1 + k)
        spark.createDataFrame([(k, "a", t, k == 1, 1, "m"), (10 + k, "b", t, False, k, None)], cols).coalesce(1).write.parquet(f"{src}/p{k}")
        path = SH.health_stream(spark, f"{src}/*", spark.read.parquet(f"{src}/p0").schema, lambda df: df, base=base)
    got = {r.rid: (r.requestsok, r.requestserr) for r in SH.health_view(spark, path).collect()}
    assert got == {"a": (2, 1), "b": (2, 0)} and SH.health_view(spark, path).filter(F.col("rid") == "a").first().lasterror == dt.datetime(2024, 1, 2)


def test_free_members_are_indexed(spark, tmp_path):
    """Members of any name, other ones in the second batch; numbers are kept but not indexed."""
    one = ['{"hits":[{"title":"First","url":"u1","isbn":"x77 alpha","pages":42,"tags":["no"]},{"title":"Second","url":"u2"}],"resource":{"id":"lib"}}', "not json"]
    two = ['{"hits":[{"title":"First","url":"u1","author":"beta <b>gamma</b>","ok":true},{"url":"u9","rid":"own","note":"no title"},{"title":"Third","url":"u3","rid":"own"}],"resource":{"id":"lib"}}']
    src, base, index = str(tmp_path / "src"), str(tmp_path / "job"), str(tmp_path / "index")
    to_hits = lambda p: PG.free_hits(PG.parse_result_pages(p.select(F.xxhash64("value").alias("page_id"), F.col("value").alias("json"))))
    for k, part in enumerate((one, two)):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.text(f"{src}/p{k}")
        path = SI.ingest_stream(spark, f"{src}/*", "value string", to_hits, base=base, index=index, index_how={"members": "strings"}, source_format="text")
    hits = {r.hit_id: r for r in SI.hits_view(spark, path).collect()}
    assert set(hits) == {"lib@u1", "lib@u2", "own@u9", "own@u3"}
    assert hits["lib@u1"].fields == {"title": "First", "url": "u1", "author": "beta gamma", "ok": "true"} and hits["lib@u1"].strings["rid"] == "lib"
    words = ["alpha", "42", "gamma", "true", "lib", "own", "second", "note", "b"]
    got = {}
    for r in S.search_stored(spark.createDataFrame([(w, w) for w in words], "qid string, query string"), SI.current_index(spark, index), hit_cols=("fields",)).collect():
        got.setdefault(r.qid, set()).add(r.hit_id)
    assert got == {"gamma": {"lib@u1"}, "lib": {"lib@u1", "lib@u2"}, "own": {"own@u3"}, "second": {"lib@u2"}}


def test_refresh_stream_sees_its_own_refreshes(spark, tmp_path):
    """Stale and unknown ids are asked for, a budget at a time; what came back is fresh in the next batch."""
    day = lambda d: dt.datetime(2024, 1, d)
    src, base, cat = str(tmp_path / "src"), str(tmp_path / "job"), str(tmp_path / "cat")
    stored = CAT.conform(spark.createDataFrame([("a", "A", day(1)), ("b", "B", day(9)), ("z", "Z", day(1))], "id string, name string, lastupdated timestamp"))
    EX.write_catalog(stored, F.lit(dt.datetime(1970, 1, 1)), cat)
    parent = lambda ids: ids.filter("id <> 'gone'").select("id", F.concat(F.lit("new "), "id").alias("name"))
    batches = [[("a", day(10)), ("b", day(10)), ("gone", day(10)), ("c", day(10)), (None, day(10))], [("a", day(10)), ("gone", day(11)), ("c", day(11)), ("z", day(11))]]
    for k, part in enumerate(batches):
        spark.createDataFrame(part, "rid string, ts timestamp").coalesce(1).write.parquet(f"{src}/p{k}")
        SI.refresh_stream(spark, f"{src}/*", spark.read.parquet(f"{src}/p{k}").schema, lambda df: df, cat, parent, seconds=5 * 86400, budget=2, base=base)
    log = sorted((r.batch_id, r.rid, r.found, r.asked) for r in spark.read.parquet(f"{base}/refreshed").collect())
    assert log == [(0, "a", True, day(10)), (0, "c", True, day(10)), (1, "gone", False, day(11)), (1, "z", True, day(11))]
    now = {r.id: (r.name, r.lastupdated) for r in SI.refreshed_catalog(spark, cat, base).collect()}
    assert now == {"a": ("new a", day(10)), "b": ("B", day(9)), "c": ("new c", day(10)), "z": ("new z", day(11))}
    assert {r.id for r in SI.refreshed_catalog(spark, cat, base, 1).filter("lastupdated >= '2024-01-10'").collect()} == {"a", "c"}


def test_refresh_query_takes_times_without_a_zone(spark, tmp_path):
    """Events whose times are timestamp_ntz: every slice asks as of its last time."""
    from ferret.plans import registry

    rows = [(k, dt.datetime(2024, 1, 1 + 8 * (k // 2)), 2 + k % 2) for k in range(8)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(2, "S2", 0, 10.0)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "NL")], "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    day = lambda d: dt.datetime(2024, 1, d)
    # s3 is new in the first slice, stale again after 10 days; s2 is from the first of the month
    got = registry.q_refresh_stream(spark, str(tmp_path))
    assert sorted((r.batch_id, r.rid, r.found, r.asked, r.lastupdated) for r in got.collect()) == [
        (0, "s3", True, day(1), day(17)), (2, "s2", True, day(17), day(17)), (2, "s3", True, day(17), day(17))]


def test_log_touches_the_buckets_of_its_keys(spark, tmp_path):
    path, now = str(tmp_path / "log"), {}
    for k in range(6):
        keys = range(100) if k == 0 else range(10 * k, 10 * k + 3)
        now.update({f"h{i}": f"t{k}" for i in keys})
        df = spark.createDataFrame([(f"h{i}", f"t{k}") for i in keys] * 2, "hit_id string, title string")
        for _ in range(2):  # a batch run again replaces itself
            C.write_log(df, k, path, ["hit_id"])
    view = lambda ids=None: {r.hit_id: r.title for r in SI.hits_view(spark, path, ids).collect()}
    assert view() == now
    before = C.log_batches(spark, path)
    assert len(before) == C.BUCKETS and sum(len(n) > 1 for n in before.values()) <= 15
    wanted = spark.createDataFrame([("h10",), ("h11",), ("none",)], "hit_id string")
    assert view(wanted) == {"h10": now["h10"], "h11": now["h11"]}
    read = {f.split("bucket=")[1].split("/")[0] for f in C.read_log(spark, path, ["hit_id"], wanted).inputFiles()}
    assert len(read) <= 3
    files = lambda: {f: n for f in C.read_log(spark, path, ["hit_id"]).inputFiles() for n in (f.split("bucket=")[1].split("/")[0],)}
    old, done = files(), C.compact_log(spark, path, ["hit_id"], most=1)
    assert done == sorted(b for b, n in before.items() if len(n) > 1)
    assert view() == now and all(len(n) == 1 for n in C.log_batches(spark, path).values())
    assert {f for f, b in old.items() if int(b) not in done} == {f for f, b in files().items() if int(b) not in done}
    assert C.compact_log(spark, path, ["hit_id"], most=1) == []
