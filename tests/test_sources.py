"""Readers and sinks: resource files, catalogue save and reload, exports."""

import datetime as dt
import json

from pyspark.sql import functions as F

from ferret.operators import catalog as CAT
from ferret.sources import exports as EX
from ferret.sources import pages as PG

RESOURCE = {
    "resource": {
        "id": "orchard", "name": "Orchard", "mimetype": "text/html", "apitemplate": "https://o.example.net/?q={searchTerms}&k={apikey}",
        "itempath": "//li", "extractors": {"title": "./b", "url": "./a/@href"},
        "headers": {"Accept": "text/html"}, "privateparameters": {"apikey": "SECRET"}, "prior": 0.7,
        "maxqueriesperday": 42,
    }
}


def test_read_resources_defaults_and_bad_text(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text(json.dumps(RESOURCE))
    bare = tmp_path / "bare.json"
    bare.write_text('{"resource": {"id": "index", "apitemplate": "http://x/index?q={q}"}}')
    trailing = tmp_path / "trailing.json"
    trailing.write_text('{"resource": {"id": "search", "directaccess": "yes",}}')
    df = PG.read_resources(spark, str(tmp_path))
    rows = {r.id: r for r in df.collect()}
    assert rows["orchard"].maxqueriesperday == 42 and rows["orchard"].privateparameters == {"apikey": "SECRET"}
    assert rows["index"].mimetype == CAT.DEFAULT_MIMETYPE and rows["index"].testquery == CAT.DEFAULT_TESTQUERY
    assert rows["index"].maxqueriesperday == 1000 and rows["index"].deleted is False
    assert "search" not in rows  # strict JSON: the trailing comma makes the file unreadable
    raw = spark.read.text(str(tmp_path), wholetext=True).select(F.col("value").alias("json"))
    assert PG.bad_resources(raw).count() == 1


def test_shared_export_hides_private_parameters(spark):
    df = spark.createDataFrame([(json.dumps(RESOURCE),)], "json string")
    cat = PG.parse_resources(df)
    text = EX.to_json_lines(EX.catalog_shared(cat)).first().value
    assert "SECRET" not in text and '"maxqueriesperday":42' in text
    assert "privateparameters" not in text
    unshared = json.loads(EX.to_json_lines(EX.catalog_unshared(cat)).first().value)
    assert unshared["mimetype"] == "text/html" and "apitemplate" not in unshared


def test_tombstone_export_is_id_and_deleted_only(spark):
    cat = CAT.conform(spark.createDataFrame([("gone", "Name", True)], "id string, name string, deleted boolean"))
    assert json.loads(EX.to_json_lines(EX.catalog_shared(cat)).first().value) == {"id": "gone", "deleted": True}


def test_catalog_save_and_reload(spark, tmp_path):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    v1 = CAT.conform(spark.createDataFrame([("a", "A1", t0), ("b", "B", t0)], "id string, name string, lastupdated timestamp"))
    v2 = CAT.conform(spark.createDataFrame([("a", "A2", t1), ("b", "B", t0)], "id string, name string, lastupdated timestamp"))
    path = str(tmp_path / "cat")
    mark = EX.write_catalog(v1, F.lit(dt.datetime(1970, 1, 1)), path).first().since
    assert mark == t0
    EX.write_catalog(v2, F.lit(t0), path)  # >= the mark: a same-second update is kept
    cat, since = PG.read_catalog(spark, path)
    got = {r.id: r.name for r in cat.collect()}
    assert got == {"a": "A2", "b": "B"} and since.first().since == t1


def test_export_hits_and_local_projection(spark):
    hits = spark.createDataFrame([("h", "T", None)], "hit_id string, title string, url string")
    assert json.loads(EX.export_hits(hits, ["title", "url"]).first().value) == {"title": "T"}
    mother = spark.createDataFrame([("m", "Mother", "http://m/fav.png", "q")], "id string, name string, favicon string, testquery string")
    r = EX.local_projection(mother).first()
    assert (r.id, r.name, r.favicon, r.testquery, r.mimetype) == ("m", "Mother", "http://m/fav.png", "q", CAT.DEFAULT_MIMETYPE)


def test_result_page_censor_and_order(spark):
    hits = spark.createDataFrame([(1, 2, "B", "r", "q"), (1, 1, "<b>A</b>", "r", "q")], "qid long, pos int, title string, rid string, query string")
    page = json.loads(EX.result_page(hits, ["qid"], censor=True).first().json)
    assert page == {"hits": [{"title": "A"}, {"title": "B"}]}
