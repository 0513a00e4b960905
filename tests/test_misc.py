"""Smaller operators: paging window, allowance, staleness, provenance, id
checks, lookups, cached results, health summary and uptime."""

import datetime as dt

from pyspark.sql import functions as F

from ferret.functions import health as H
from ferret.operators import catalog as CAT
from ferret.operators import health as HL
from ferret.operators import requests as RQ
from ferret.operators import sampling as SMP


def now():
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))


def test_page_window(spark):
    df = spark.createDataFrame([("2", "10"), (None, None), ("x", "500"), ("-3", "0"), ("3", "y")], "page string, max string")
    m, start = H.page_window("page", "max")
    assert [tuple(r) for r in df.select(m, start).collect()] == [(10, 10), (10, 0), (200, 0), (1, 0), (10, 20)]


def test_allowance_and_seconds_ago(spark):
    df = spark.createDataFrame([(0.5, dt.datetime(2024, 1, 31, 12)), (990.0, dt.datetime(2024, 1, 1)), (3.0, dt.datetime(2024, 2, 2))],
                               "a double, t timestamp")
    got = [r[0] for r in df.select(H.allowance("a", "t", F.lit(1000), now())).collect()]
    assert got == [500, 1000, -997]  # half a day refills 500; capped at the rate; a later last use counts negative
    ago = [r[0] for r in df.select(H.seconds_ago("t", now())).collect()]
    assert ago == [12 * 3600 + 1, 31 * 86400 + 1, 8640000]


def test_effective_prior_floor_of_one_week(spark):
    df = spark.createDataFrame([(0.1, 100800, 0, dt.datetime(2024, 1, 31))], "p double, ok int, err int, up timestamp")
    got = df.select(H.effective_prior("p", "ok", "err", "up", now())).first()[0]
    assert abs(got - (0.1 + 100800 / (604800000 // 6000))) < 1e-12


def test_stale_and_refresh_budget(spark):
    cat = spark.createDataFrame([("a", dt.datetime(2024, 1, 31, 23, 30)), ("b", dt.datetime(2024, 1, 1))], "id string, lastupdated timestamp")
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "rid string")
    assert sorted(r.rid for r in CAT.stale(req, cat, 7200, now()).collect()) == ["b", "c"]
    many = spark.createDataFrame([(1, f"r{i:02d}") for i in range(20)], "batch_id int, rid string")
    assert CAT.refresh_budget(many, "batch_id", [F.col("rid")]).count() == 11


def test_provenance_and_id_checks(spark):
    hits = spark.createDataFrame([("h", "r", "q", False), ("g", "r", "q", True)], "hit_id string, rid string, query string, trusted boolean")
    out = {r.hit_id: (r.rid, r.query) for r in CAT.strip_provenance(hits, F.col("trusted")).collect()}
    assert out == {"h": (None, None), "g": ("r", "q")}
    upd = spark.createDataFrame([("mother",), ("x",)], "id string")
    cat = spark.createDataFrame([("me",), ("y",)], "id string")
    probs = sorted(tuple(r) for r in CAT.check_ids(upd, cat, "mother", "me").collect())
    assert probs == [("me", "server id already exists"), ("mother", "reserved id")]


def test_lookups_delete_and_allowance_copy(spark):
    cat = spark.createDataFrame([("a", 5), ("b", 7)], "id string, dayallowance int")
    ids = spark.createDataFrame([("a",), ("z",)], "id string")
    assert [r.id for r in CAT.get_by_id(cat, ids).collect()] == ["a"]
    assert {r.id: r.known for r in CAT.contains_id(ids, cat).collect()} == {"a": True, "z": False}
    kept, unknown = CAT.delete_resource(cat, ids)
    assert [r.id for r in kept.collect()] == ["b"] and [r.id for r in unknown.collect()] == ["z"]
    other = spark.createDataFrame([("b", 99)], "id string, dayallowance int")
    assert {r.id: r.dayallowance for r in CAT.update_allowance(cat, other).collect()} == {"a": 5, "b": 99}


def test_cache_first_in_queue_and_cached_results(spark):
    queue = spark.createDataFrame([
        (1, "q", "r", dt.datetime(2024, 1, 2)), (2, "q", "r", dt.datetime(2024, 1, 1)), (3, None, "r", dt.datetime(2024, 1, 1)),
    ], "page_id long, query string, rid string, ts timestamp")
    reqs = spark.createDataFrame([(10, "q", "r"), (11, "q", "other"), (12, None, "r")], "req_id long, query string, rid string")
    got = {r.req_id: r.page_id for r in RQ.cache_lookup(reqs, queue).collect()}
    assert got == {10: 2, 11: None, 12: None}
    pages = spark.createDataFrame([(2, 1, ("T", "r", "q"))], "page_id long, pos int, hit struct<title:string, rid:string, query:string>")
    res = RQ.cached_results(reqs, queue, pages).collect()
    assert len(res) == 1 and res[0].hit.asDict() == {"title": "T"}


def test_health_summary_and_uptime(spark):
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    h = spark.createDataFrame([
        ("a", 5, 0, t2, None, None), ("b", 1, 2, t1, t2, "boom"), ("c", 0, 1, None, t1, "bad"),
    ], "rid string, requestsok int, requestserr int, lastsuccess timestamp, lasterror timestamp, lastmessage string")
    s = HL.health_summary(h).first()
    assert (s.enginesok, s.engineserr, s.lastmessage) == (1, 2, "c: bad")
    res = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    rep = {r.rid: (r.conclusion, r.uptime) for r in HL.uptime_report(res, h).collect()}
    # never failed and answered later: Ok
    assert rep["a"][0] == "Ok" and rep["b"][0] == "Error" and rep["z"][0] == "No health"
    bad = h.filter("rid = 'b'").withColumn("rid", F.lit("m"))
    s = HL.health_summary(h, mother=bad).first()
    assert (s.enginesok, s.engineserr, s.lastmessage) == (1, 3, "m (mother): boom")
    s = HL.health_summary(h.filter("rid = 'a'"), mother=h.filter("rid = 'a'")).first()
    assert (s.enginesok, s.engineserr, s.lastmessage) == (2, 0, None)
    assert abs(rep["a"][1] - 100 * 5 / 5.01) < 1e-9


def test_not_yet_seen(spark):
    seen = spark.createDataFrame([("a",), ("b",)], "rid string")
    done = spark.createDataFrame([("a",)], "rid string")
    assert [r.rid for r in SMP.not_yet_seen(seen, done).collect()] == ["b"]


def test_result_quality_rules_hold_for_the_test_query_only(spark):
    rows = [("a", "t", "t", None, None, None, None, None, None, None), ("a", "x", "t", None, None, None, None, None, None, None),
            ("b", "t", "t", None, "h", "", None, None, None, None), ("b", "x", "t", None, "h", "", None, None, None, None),
            ("c", "x", "t", "yes", "h", "T", "c", "tmpl", "tmpl", "yes"), ("d", "x", "t", "yes", "h", "T", "e", "tmpl", "tmpl", "yes"),
            ("e", "x", "t", "no", "h", "T", "e", "tmpl", "other", "no"), ("f", "x", "t", "no", "h", "T", "f", "tmpl", "tmpl", None)]
    df = spark.createDataFrame(rows, "rid string, query string, testquery string, directaccess string, hit_id string, title string, "
                                     "page_id string, apitemplate string, page_apitemplate string, page_directaccess string")
    df = df.withColumn("rerank", F.lit(None).cast("string")).withColumn("hit_rid", F.lit(None).cast("string"))
    got = {(r.rid, r.query): r.error for r in HL.result_quality(df).collect()}
    assert got[("a", "t")] == "No results for test query: t" and got[("a", "x")] is None
    assert got[("b", "t")].startswith("Search result must") and got[("b", "x")] is None and got[("c", "x")] is None
    assert [got[(k, "x")].split()[-1] for k in "def"] == ["Id.", "APItemplate.", "'directaccess'."]


def test_plan_cached_redirect_and_signed(spark):
    t = "https://h/{rid}?q={searchTerms}&p={startPage?}"
    cat = spark.createDataFrame([("a", t, "yes", None), ("b", t, "no", None), ("c", t, None, "HMAC")],
                                "id string, apitemplate string, directaccess string, signature string")
    cat = cat.withColumn("apitemplate", F.replace("apitemplate", F.lit("{rid}"), F.col("id")))
    req = spark.createDataFrame([(1, "a", "x", 3), (2, "b", "x", 3), (3, "b", "y", 3), (4, "c", "x", 3)], "req_id long, rid string, query string, page int")
    no = spark.createDataFrame([(k, False) for k in (2,)], "req_id long, accepted boolean")
    got = {r.req_id: (r.action, r.url, r.error) for r in RQ.plan_requests(req, cat, no, spark.createDataFrame([(2,)], "req_id long")).collect()}
    assert got[1] == ("redirect", "https://h/a?q=x&p=", None) and got[2] == ("cached", None, None)
    assert got[3][:2] == ("fetch", "https://h/b?q=y&p=3") and got[4][0] == "error"
