"""Catalogue merge (M4/M5), upsert (M3), tombstones, validation."""

import datetime as dt

from pyspark.sql import functions as F

from ferret.operators import catalog as CAT

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("id string, name string, prior double, deleted boolean, privateparameters map<string,string>, "
          "headers map<string,string>, requestsok int, requestserr int, upsince timestamp, lastupdated timestamp, lastmessage string")


def now():
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))


def test_merge_rules(spark):
    cat = spark.createDataFrame([
        ("a", "A", 0.5, False, {"k": "old"}, None, 3, 1, T0, T0, "msg"),
        ("b", "B", 0.5, False, {"k": "old"}, None, 3, 1, T0, T0, "msg"),
        ("c", "C", 0.5, False, None, {"h": "1"}, 3, 1, T0, T0, "msg"),
        ("z", "Z", 0.1, False, None, None, 1, 0, T0, T0, None),
    ], SCHEMA)
    upd = spark.createDataFrame([
        ("a", "A", 0.5005, False, {"k": "new"}, None),  # prior within tolerance, new private key: unchanged
        ("b", "B2", 0.5, False, {"k": "new"}, None),  # renamed: changed
        ("c", "C", 0.5, False, None, {"h": "2"}),  # header changed
        ("n", "N", 0.2, False, None, None),  # new
    ], "id string, name string, prior double, deleted boolean, privateparameters map<string,string>, headers map<string,string>")
    m = {r.id: r for r in CAT.merge_resources(cat, upd, now()).collect()}
    assert m["a"].privateparameters == {"k": "old"} and m["a"].requestsok == 3 and m["a"].lastmessage == "msg"
    assert m["a"].lastupdated == dt.datetime(2024, 2, 1) and m["a"].upsince == T0
    assert m["b"].name == "B2" and m["b"].privateparameters == {"k": "new"} and m["b"].requestsok == 0
    assert m["b"].upsince == dt.datetime(2024, 2, 1) and m["b"].lastmessage is None
    assert m["c"].headers == {"h": "2"}
    assert m["n"].mimetype == CAT.DEFAULT_MIMETYPE and m["n"].maxqueriesperday == 1000
    assert m["z"].lastupdated == T0 and m["z"].requestsok == 1


def test_merge_is_idempotent(spark):
    cat = spark.createDataFrame([("a", "A", 0.5, False, None, None, 3, 1, T0, T0, None)], SCHEMA)
    upd = spark.createDataFrame([("a", "B", 0.1, False), ("n", "N", 0.2, False)], "id string, name string, prior double, deleted boolean")
    once = CAT.merge_resources(cat, upd, now())
    twice = CAT.merge_resources(once, upd, now())
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_tombstone_flows_through_merge(spark):
    cat = spark.createDataFrame([("a", "A", 0.5, False, None, None, 3, 1, T0, T0, None)], SCHEMA)
    ts = CAT.tombstone(spark.createDataFrame([("a",)], "id string"))
    r = CAT.merge_resources(cat, ts, now()).first()
    assert r.deleted is True and r.name is None


def test_upsert_last_writer_wins_and_hot_key(spark):
    base = spark.createDataFrame([("x", "old", 0), ("y", "keep", 0)], "hit_id string, title string, seq long")
    upd = spark.range(50000).select(F.lit("x").alias("hit_id"), F.col("id").cast("string").alias("title"), (F.col("id") + 1).alias("seq"))
    out = {r.hit_id: r.title for r in CAT.upsert_hits(base, upd).collect()}
    assert out == {"x": "49999", "y": "keep"}


def test_validation_rules(spark):
    df = CAT.conform(spark.createDataFrame([
        ("ok", None, None, None, None),
        ("bad", "yes", "p=1", {"k": "v"}, "file:///etc"),
        (None, None, None, None, None),
    ], "id string, directaccess string, post string, privateparameters map<string,string>, apitemplate string"))
    v = {r.id: r.violations for r in CAT.valid_resource(df).collect()}
    assert v["ok"] == [] and len(v["bad"]) == 3 and v[None] == ["Missing Identifier"]


def test_stamp_only_fills_absent(spark):
    df = spark.createDataFrame([("h1", None, None), ("h2", "r", "2020-01-01")], "hit_id string, rid string, foundBefore string")
    out = {r.hit_id: (r.rid, r.foundBefore) for r in CAT.stamp(df, F.lit("me"), now()).collect()}
    assert out == {"h1": ("me", "2024-02-01"), "h2": ("r", "2020-01-01")}
