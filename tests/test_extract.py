"""Extraction: tolerant HTML paths, native links, XML, JSON pages, callbacks; bad pages and paths are rows."""

import json

from pyspark.sql import functions as F

from ferret.operators import extract as X
from ferret.sources import pages as PG

HTML = """<html><body><div class="result"><h3><a href="/one">First <b>hit</b></a></h3><p>About one<br>more</div>
<div class="result"><h3><a href="two.html">Second</a></h3><p>About two</p></div>
<div class="ad"><a href="/ad">Ad</a></div></body></html>"""


def page(spark, *texts, url="http://example.org/search/q"):
    return spark.createDataFrame([(k, url, t, "r") for k, t in enumerate(texts, 1)], "page_id long, url string, html string, rid string")


def rows(df):
    return [(r.page_id, r.pos, dict(r.fields), r.error) for r in df.orderBy("page_id", "pos").collect()]


def test_html_paths_with_unclosed_tags(spark):
    out = rows(X.extract_html(page(spark, HTML), "//div[@class='result']", {"title": ".//h3", "url": ".//a/@href", "description": "./p"}))
    assert [(f["title"], f["url"]) for _, _, f, _ in out] == [
        ("First hit", "http://example.org/one"), ("Second", "http://example.org/search/two.html")]
    assert out[1][2]["description"] == "About two"
    bad = rows(X.extract_html(page(spark, HTML), "//div[", {"title": "."}))
    assert len(bad) == 1 and bad[0][1] == 0 and bad[0][3]


def test_native_links_take_all_items(spark):
    pages = page(spark, "<ul><li><a href='x'>no</a></li><li><a href=\"/a\">A</a></li></ul>", "".join(f'<li><a href="/{k}">T{k}</a></li>' for k in range(45)))
    out = X.extract_links(pages).orderBy("page_id", "pos").collect()
    assert [(r.pos, r.title, r.url, r.rid) for r in out[:2]] == [(1, "no", "http://example.org/search/x", "example.org"), (2, "A", "http://example.org/a", "example.org")]
    assert len(out) == 47 and X.extract_links(pages, limit=30).count() == 32


def test_native_links_equal_the_tree(spark):
    """Unclosed items, three ways of quoting, lists in items, text after a list."""
    html = ['<ul><li><a href="/a">A</a><li><a href="/b">B</a></ul>', "<ul><li><a class=x href='/q'>Q</a><LI><A HREF=/u>U</A></ul>",
            '<ul><li><a href="/top">Top</a><ul><li><a href="/in">In</a></li></ul></li><li><a href="/next">N</a></li></ul> <a href="/no">no</a>',
            "<ol><li><a href=/open>never <b>closed</b></ol><p>x</p>", "<ul><li>no link</li></ul><link href='/z'><listing><a href='/l'>l</a></listing>"]
    native = X.extract_links(page(spark, *html)).select("page_id", "pos", "title", "url").collect()
    tree = X.extract_html(page(spark, *html), "//li", {"title": "./a", "url": "./a/@href"}).collect()
    want = sorted((r.page_id, r.pos, r.fields.get("title"), r.fields.get("url")) for r in tree if r.fields)
    assert sorted(map(tuple, native)) == want and len(want) == 8


def test_xml_items(spark):
    xml = ('<?xml version="1.0"?><rss xmlns:dc="http://x/"><channel><item><title>A</title><link>http://a/1</link><c>x</c><c>y</c></item>'
           "<item kind='n'><title>B <b>bold</b></title><dc:creator>me</dc:creator><link>/2</link></item></channel></rss>")
    pages = page(spark, xml, "<rss><item><title>never closed", None, "<a><item><item><title>in</title></item></item></a>")
    out = rows(X.extract_xml(pages, "//item", {"title": "./title", "url": "./link", "c": "./c", "kind": "./@kind"}))
    assert out[0][2] == {"title": "A", "url": "http://a/1", "c": "x y"}
    assert out[1][2] == {"title": "B bold", "url": "http://example.org/2", "kind": "n"}
    assert [(r[0], r[1], bool(r[3])) for r in out[2:]] == [(2, 0, True), (3, 0, True), (4, 0, True)]
    assert [r[2]["title"] for r in rows(X.extract_xml(page(spark, xml), "//item[./c]", {"title": "./title"}))] == ["A"]
    many = "<r>" + "".join(f"<item><title>{k}</title></item>" for k in range(50)) + "</r>"
    assert X.extract_xml(page(spark, many), "/r/item", {"title": "./title"}).count() == 30


def test_json_pages_keep_scalars_only(spark):
    text = '{"hits":[{"title":"<b>T</b>","score":1.5,"tags":["x"],"meta":{"a":1},"ok":true,"n":null}],"resource":{"id":"r1"},"query":"q"}'
    df = spark.createDataFrame([(1, text), (2, '{"resource":{"id":"r2"}}'), (3, "not json")], "page_id long, json string")
    hits = PG.normalize_hits(PG.parse_result_pages(df)).collect()
    assert len(hits) == 1
    h = hits[0]
    assert (h.rid, h.query, h.pos) == ("r1", "q", 1)
    assert h.fields == {"title": "T", "score": "1.5", "ok": "true"}


def test_json_rule(spark):
    text = '{"hits":[{"title":"A","url":"/a","t":["x","y"],"o":{"k":1}},{"title":"B","link":{"href":"http://b"}}]}'
    out = rows(X.extract_json(page(spark, text, "{bad"), "//hits", {"title": "./title", "url": "./url", "t": "t", "o": "./o", "l": "./link/href"}))
    assert out[0][2] == {"title": "A", "url": "http://example.org/a", "t": "x y"} and out[1][2] == {"title": "B", "l": "http://b"}
    assert out[2][:2] == (2, 0) and out[2][3] == "Malformed JSON"
    assert [r[2]["title"] for r in rows(X.extract_json(page(spark, '[{"t":"x"},{"t":"y"}]'), "//list", {"title": "./t"}))] == ["x", "y"]
    assert rows(X.extract_json(page(spark, text), "//hits[1]", {"title": "./title"}))[0][1] == 0
    many = json.dumps({"a": {"b": [{"t": k} for k in range(40)]}})
    assert X.extract_json(page(spark, many), "/a/b", {"title": "./t"}).count() == 30


def test_callback_rule(spark):
    out = rows(X.extract_callback(page(spark, 'cb([{"t":"a","url":"u1"},{"t":"b"},{broken}])', 'cb({"t":"outer","m":{"t":"inner"}})'), {"title": "./t", "url": "url"}))
    assert [r[2].get("title") for r in out[:2]] == ["a", "b"] and out[0][2]["url"] == "http://example.org/search/u1"
    assert out[2] == (2, 1, {"title": "outer"}, None)
    odd = ['cb({"t":"a {b} c","m":{"x":{"t":1}}},{"t":"z}"},{broken},} {"t":"after"} {"open":1', None, 'f([{"t":"\\"}"}])', "", "no objects"]
    out = rows(X.extract_callback(page(spark, *odd), {"title": "./t", "x": "./m/x/t"}))
    assert out == [(1, 1, {"title": "a {b} c", "x": "1"}, None), (1, 2, {"title": "z}"}, None), (1, 3, {"title": "after"}, None), (3, 1, {"title": '"}'}, None)]
    many = "cb(" + ",".join('{"t":{"u":%d}}' % k for k in range(50)) + ")"
    assert [r[2]["title"] for r in rows(X.extract_callback(page(spark, many), {"title": "./t/u"}))] == [str(k) for k in range(30)]


def test_json_at_any_depth(spark):
    deep = {"title": "x"}
    for k in range(40):  # deeper than one pass of the walk
        deep = {"a": [deep, {"hits": {"title": f"d{k}"}}]}
    pages = page(spark, '{"response":{"hits":[{"title":"A","more":{"hits":[{"title":"in","l":[{"h":"u1"},{"h":"u2"}]}]}},{"title":"B"}]},"z":{"hits":{"title":"C"}}}',
                 json.dumps(deep), '[{"t":"x"},[{"t":"z"}]]', "{bad", '{"x":1}')
    out = rows(X.extract_json(pages, "//hits", {"title": "./title", "l": "./l/h", "all": ".//title"}))
    assert [r[:3] for r in out if r[0] == 1] == [(1, 1, {"title": "A", "all": "in A"}), (1, 2, {"title": "in", "l": "u1 u2", "all": "in"}),
                                                 (1, 3, {"title": "B", "all": "B"}), (1, 4, {"title": "C", "all": "C"})]
    assert [r[2]["title"] for r in out if r[0] == 2] == [f"d{k}" for k in range(30)]
    assert [r[0] for r in out if r[0] > 2] == [4] and out[-1][3] == "Malformed JSON"
    assert [r[2].get("t") for r in rows(X.extract_json(pages, "//list", {"t": "./t"})) if r[0] == 3] == ["x", None, "z"]
    assert [r[2]["title"] for r in rows(X.extract_json(pages, "//more/hits", {"title": "title"})) if r[0] == 1] == ["in"]
    assert [r[2]["title"] for r in rows(X.extract_json(pages, "/response/hits", {"title": "title"})) if r[0] == 1] == ["A", "B"]
    assert X.extract_json(pages, "//hits", {"title": ".//title"}, limit=2).filter("page_id = 1").count() == 2


def test_one_format_in_the_other(spark):
    text = '{"items":[{"html":"<div><a href=\\"/z\\">Zed</a></div>"},{"html":"<a>Y</a>"}]}'
    out = rows(X.extract_json_of_html(page(spark, text), "//items", "html", {"title": ".//a", "url": ".//a/@href"}))
    assert [r[2] for r in out] == [{"title": "Zed", "url": "http://example.org/z"}, {"title": "Y"}]
    html = "<div class='r' data-x='{\"title\": \"T1\"}'></div><div class='r' data-x=\"{&quot;title&quot;: &quot;T2&quot;}\"></div>"
    assert [r[2]["title"] for r in rows(X.extract_html_with_json(page(spark, html), "div", "data-x", {"title": "./title"}))] == ["T1", "T2"]


def test_pages_by_rule(spark):
    pages = page(spark, '{"hits":[{"title":"R"}]}', "<r><i><t>X</t></i></r>", "?", "?", "nope").withColumn("rid", F.concat(F.lit("r"), F.col("page_id").cast("string")))
    rules = [{"rid": "r1"}, {"rid": "r2", "mimetype": "application/xml", "itempath": "//i", "extractors": {"title": "./t"}},
             {"rid": "r3", "mimetype": "image/png"}, {"rid": "r5"}]
    out = rows(X.extract_pages(pages, rules))
    assert [r[2].get("title") for r in out[:2]] == ["R", "X"]
    assert [(r[0], r[1]) for r in out[2:]] == [(3, 0), (4, 0), (5, 0)] and all(r[3] for r in out[2:])


def test_pages_are_dealt_and_read_in_small_lots(spark, monkeypatch):
    """Pages of one small file go to several tasks; one worker holds few parsed pages; rows as before."""
    monkeypatch.setattr(X, "PER_TASK", 5)
    page = "<f><i><t>a {k}</t></i><i><t>b</t></i></f>"
    pages = spark.createDataFrame([(k, "http://h/", page.replace("{k}", str(k)) if k % 10 else "<f><i>") for k in range(100)] + [(100, "http://h/", None), (101, "http://h/", "<f></f>")],
                                  "page_id long, url string, html string").coalesce(1)
    dealt = X._dealt(pages)
    assert dealt.rdd.getNumPartitions() >= 20 and dealt.count() == 102
    got = sorted((r.page_id, r.pos, r.fields.get("t"), r.error) for r in X.extract_xml(pages, "//i", {"t": "./t"}).collect())
    want = [(k, p, v, None) for k in range(100) if k % 10 for p, v in ((1, f"a {k}"), (2, "b"))] + [(k, 0, None, "Malformed XML") for k in (*range(0, 100, 10), 100)]
    assert got == sorted(want)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    import pyarrow as pa

    schema = to_arrow_schema(StructType.fromDDL("page_id long, base string, pos int, fields map<string,string>, error string"))
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(200)), "base": ["http://h/"] * 200, "html": ["<li><a href=x>y</a>" * 3] * 199 + [""]})
    out = list(X._html_items("//li", {"title": "./a"}, 2, schema, iter([batch])))
    assert len(out) > 3 and max(b.num_rows for b in out) <= 2 * X.AT_ONCE and sum(b.num_rows for b in out) == 398
