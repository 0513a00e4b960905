from pyspark.sql import functions as F

from ferret.functions import urls as U


def test_absolute_url_forms(spark):
    rows = [
        ("http://example.com/a/b.html", "c.html", "http://example.com/a/c.html"),
        ("http://example.com/a/b.html", "/c", "http://example.com/c"),
        ("https://example.com/a/b.html", "//x.org/c", "https://x.org/c"),
        ("http://ex.com", "c", "http://ex.com/c"),
        ("http://example.com/a", "https://z/q", "https://z/q"),
        (None, "c", "c"),
    ]
    df = spark.createDataFrame(rows, "base string, url string, want string")
    for r in df.select(U.absolute_url("base", "url").alias("got"), "want").collect():
        assert r.got == r.want


def test_fill_template_order_and_literal_values(spark):
    df = spark.createDataFrame(
        [("http://a/?q={searchTerms}&p={startPage?}&k={key}&o={opt?}", "a b", None, {"key": "S$1"})],
        "t string, q string, p int, m map<string,string>",
    )
    url, err = U.fill_template("t", U.form_encode("q"), "p", "m")
    r = df.select(url.alias("u"), err.alias("e")).first()
    assert r.u == "http://a/?q=a+b&p=&k=S$1&o=" and r.e is None


def test_fill_template_missing_parameter(spark):
    df = spark.createDataFrame([("http://a/{x}?q={q}", "z", 2)], "t string, q string, p int")
    url, err = U.fill_template("t", "q", "p", F.lit(None).cast("map<string,string>"))
    r = df.select(url.alias("u"), err.alias("e")).first()
    assert r.u is None and r.e == "Missing url parameter {x}"


def test_start_page_without_page_fills_only_required_slot(spark):
    df = spark.createDataFrame([("a={startPage}&b={startPage?}",)], "t string")
    url, _ = U.fill_template("t", F.lit("q"), F.lit(None).cast("int"), F.lit(None).cast("map<string,string>"))
    assert df.select(url).first()[0] == "a=1&b="


def test_redact_never_shows_secret(spark):
    df = spark.createDataFrame([("java.io.IOException: https://x/?key=SECRET failed for SECRET", {"apikey": "SECRET"})], "m string, p map<string,string>")
    out = df.select(U.redact("m", "p")).first()[0]
    assert "SECRET" not in out and out == "IOException failed for {apikey}"


def test_resource_url_replaces_last_occurrence_or_fails(spark):
    df = spark.createDataFrame([("http://x/me/search/me?q={searchTerms}", "me"), ("http://x/search", "randomid")], "t string, me string")
    got = [tuple(r) for r in df.select(*U.resource_url("t", "me", F.lit("new id"))).collect()]
    # filled with an empty query; a template without the own id is an error
    assert got[0] == ("http://x/me/search/new+id?q=", None) and got[1][0] is None and got[1][1]


def test_encode_query_modes(spark):
    df = spark.createDataFrame([('a "b"', None), ('a "b"', "application/json"), ('a "b"', "text/plain")], "q string, m string")
    got = [r[0] for r in df.select(U.encode_query("q", "m")).collect()]
    assert got == ["a+%22b%22", 'a \\"b\\"', 'a "b"']


def test_templates_and_hash(spark):
    df = spark.createDataFrame([("http://x/y/?q=1", "http://x/y/?q=2", "http://x/y/")], "a string, b string, c string")
    r = df.select(U.same_template("a", "b"), U.normalize_template("c", F.lit("r")), U.hash_key(F.lit("abc"))).first()
    assert r[0] is True
    assert r[1] == "http://x/y/r?q={searchTerms}&page={startPage?}"
    assert r[2] == "900150983cd24fb0d6963f7d28e17f72"
